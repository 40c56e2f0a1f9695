"""Extension: edges that arrive in files, answered as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.module import likutay
from ..schema import EDGES


def stream_edges(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Edges from parquet files that are put into folder."""
    reader = spark.readStream.schema(EDGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def answer_stream(edges: DataFrame, query: Callable[..., DataFrame], *params, sink: str, checkpoint: str):
    """Starts a query that appends its hits to the parquet folder sink. The queries without a cap are plain filters, so they hold
    no state; a file's hits are written once, as the checkpoint says which files are done. `likutay` compares all hits with each other, so it has no answer on a stream."""
    if edges.isStreaming and query is likutay:
        raise ValueError("likutay needs all edges at once")
    hits = query(edges, *params)
    return hits.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
