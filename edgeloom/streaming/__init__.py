from .edges import answer_stream, stream_edges

__all__ = ["answer_stream", "stream_edges"]
