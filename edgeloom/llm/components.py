"""Connected components by alternating large-star and small-star steps, on executors alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_hot, stored


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Links each larger neighbour of a node to the least one around the node. edges: a > b, n of them."""
    down = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = stored(edges.union(down).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    out = stored(join_hot(down, least.select("a", "m"), ["a"], least, n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
    forget(least)
    return out


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them. edges: a > b, n of them."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    moved = join_hot(edges, least.select("a", "m"), ["a"], least, n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = stored(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    forget(least)
    return out


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges: a, b longs, links without direction. Returns node, root: root is the least node that node reaches.

    Each step is written to the shared folder, so that lost executors cost one step, and the one before is deleted.
    Rows with a null and links of a node to itself say nothing. No links: no rows. The
    number of rounds grows with the logarithm of the longest chain. Nodes with very many links are no hot keys: see join_hot().
    """
    now = stored(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    # Of one pass over the links: their number and a sum of hashes, which tell whether anything moved.
    signed = lambda links: links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    sign = signed(now)
    for _ in range(most_rounds):
        large = _large_star(now, sign[0])
        forget(now)
        # A large star never has more links than there were.
        now = _small_star(large, sign[0])
        forget(large)
        got = signed(now)
        if got == sign:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        sign = got
    raise RuntimeError("the components did not settle")
