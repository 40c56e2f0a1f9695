from .registry import GraphResult, check_loaded, run

__all__ = ["GraphResult", "check_loaded", "run"]
