"""Extensions: what the pages offer to ask but never answer, and asking for many topics at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import truthy
from ..sources.storage import stored

#: Topics that one scan looks for; more take a scan for each so many.
BLOCK_TOPICS = 500


def paths(edges: DataFrame, one: str, other: str, depth: int = 1) -> DataFrame:
    """The edges on a shortest way of depth edges at most between exactly two topics, whatever their kind and direction: edges' columns and hop.

    depth 1 gives the edges between the two. From either end the nodes reached are kept by their distance, one join for each step, and an edge lies on a
    shortest way where the distances of its ends add up.
    """
    if one == other:
        return edges.filter((F.col("node1_id") == one) & (F.col("node2_id") == one)).withColumn("hop", F.lit(1))
    ok = edges.filter(truthy(F.col("node1_id")) & truthy(F.col("node2_id")))
    both = stored(ok.select(F.col("node1_id").alias("a"), F.col("node2_id").alias("b")).union(ok.select("node2_id", "node1_id")).distinct(), "ends")

    def reached(start: str) -> DataFrame:
        """Each front is a table of its own, so a step's plan doesn't hold the steps before it."""
        seen = front = stored(edges.sparkSession.createDataFrame([(start, 0)], "id string, d int"), "front")
        for step in range(1, depth + 1):
            new = front.join(both, front.id == both.a).select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
            front = stored(new.withColumn("d", F.lit(step)), "front")
            if front.isEmpty():
                break
            seen = seen.union(front)
        return seen

    near = reached(one)
    length = near.filter(F.col("id") == other).select("d").first()
    if length is None:
        return edges.filter(F.lit(False)).withColumn("hop", F.lit(1))
    far = reached(other)
    way = near.select("id", "d").join(far.select(F.col("id").alias("id2"), F.col("d").alias("e")), F.col("id") == F.col("id2")).filter(F.col("d") + F.col("e") == length.d).select("id", "d")
    a, b = way.select(F.col("id").alias("node1_id"), F.col("d").alias("_d1")), way.select(F.col("id").alias("node2_id"), F.col("d").alias("_d2"))
    found = ok.join(a, "node1_id").join(b, "node2_id").filter(F.abs(F.col("_d1") - F.col("_d2")) == 1)
    return found.select(*edges.columns, F.greatest("_d1", "_d2").alias("hop"))


def connected_to_any(edges: DataFrame, topics: list[str]) -> DataFrame:
    """Hits of `connected` for many topics: edges' columns and topic, an edge once for each topic that it holds. A scan looks for BLOCK_TOPICS of them."""
    if not all(topics):
        raise ValueError("topics must not be empty")
    names = list(dict.fromkeys(topics))
    holds = lambda t: F.coalesce(F.contains(F.col("node1_id"), t), F.lit(False)) | F.coalesce(F.contains(F.col("node2_id"), t), F.lit(False))
    out = None
    for at in range(0, max(1, len(names)), BLOCK_TOPICS):
        some = names[at : at + BLOCK_TOPICS]
        wanted = F.array(*map(F.lit, some)) if some else F.array().cast("array<string>")
        found = edges.withColumn("topic", F.explode(F.filter(wanted, holds)))
        out = found if out is None else out.union(found)
    return out
