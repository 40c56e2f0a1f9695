"""Neighbours of each node by the part that they play."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import js_string
from ..schema import ADVICE, ASPECT

ROLES = (ASPECT, "parent_eitza", "child_eitza")


def neighbours(edges: DataFrame, null_policy: str = "exclude") -> DataFrame:
    """A row for each end of each edge: id, role, neighbour; role and neighbour are null for other kinds of edge and where the other end is missing.

    null_policy: `exclude` has no row for a missing id, and it is no neighbour; `js` takes a missing id as the word null. This is the form for
    nodes with more neighbours than a task should hold: nothing is shuffled.
    """
    if null_policy not in ("exclude", "js"):
        raise ValueError(f"no such policy: {null_policy}")
    name = js_string if null_policy == "js" else (lambda c: c)
    rows = edges.select("type", name(F.col("node1_id")).alias("one"), name(F.col("node2_id")).alias("two"))
    known = F.col("type").isin(ASPECT, ADVICE) & F.col("one").isNotNull() & F.col("two").isNotNull()
    role = lambda advice: F.when(known, F.when(F.col("type") == ASPECT, ASPECT).otherwise(advice))
    end = lambda own, other, advice: F.struct(F.col(own).alias("id"), role(advice).alias("role"), F.when(known, F.col(other)).alias("neighbour"))
    return rows.select(F.inline(F.array(end("one", "two", "child_eitza"), end("two", "one", "parent_eitza")))).filter("id is not null")


def adjacency(edges: DataFrame, null_policy: str = "exclude") -> DataFrame:
    """A row for each end of any edge of any kind: id, bechina, parent_eitza, child_eitza, sorted lists with repeated neighbours repeated.
    A node's lists are one row; use neighbours() where these could be too long for one.

    Repeated neighbours are counted before the shuffle and written out in the node's row, one node after the other in each of the shuffle partitions."""
    pairs = neighbours(edges, null_policy).groupBy("id", "role", "neighbour").agg(F.count(F.lit(1)).cast("int").alias("n"))
    # A given number of partitions: by their size, which is that before writing out, few nodes would be put together in one task.
    dealt = pairs.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "id")
    counted = dealt.groupBy("id").agg(*(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("neighbour", "n")))).alias(r) for r in ROLES))
    return counted.select("id", *(F.flatten(F.transform(r, lambda x: F.array_repeat(x["neighbour"], x["n"]))).alias(r) for r in ROLES))


def degrees(edges: DataFrame, null_policy: str = "exclude") -> DataFrame:
    """The lengths of adjacency()'s lists, by partial aggregation."""
    return neighbours(edges, null_policy).groupBy("id").agg(*(F.count(F.when(F.col("role") == r, 1)).alias(f"n_{r}") for r in ROLES))
