"""Queries by pattern: branches whose hits follow each other, without a cap.

A branch is a kind of edge and a test; an edge that passes several branches is a hit of each. All branches are tested in one
scan: an edge is repeated once for each branch that it passes, and (branch, seq) is the order of the hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import escape_quotes, js_string, loose_equal, regex_find
from ..schema import ADVICE, ASPECT


def find_matches(edge_type: str, prop: str, value: str | int, edges: DataFrame) -> DataFrame:
    """Edges of a kind whose property loosely equals a value."""
    return edges.filter(equals(edges, edge_type, prop, value))


def find_matches_regex(edge_type: str, prop: str, pattern: str, edges: DataFrame) -> DataFrame:
    """Edges of a kind in whose property a pattern matches somewhere; an empty pattern finds nothing."""
    return edges.filter(finds(edge_type, prop, pattern))


def equals(edges: DataFrame, edge_type: str, prop: str, value: str | int) -> Column:
    return (F.col("type") == edge_type) & loose_equal(F.col(prop), value, number=edges.schema[prop].dataType.typeName() in ("integer", "long", "double"))


def finds(edge_type: str, prop: str, pattern: str) -> Column:
    return (F.col("type") == edge_type) & regex_find(F.col(prop), pattern) if pattern else F.lit(False)


def branches(edges: DataFrame, *tests: Column) -> DataFrame:
    """A hit for each edge and test that it passes, with the test's number as branch. One scan, filtered by all tests together."""
    passed = F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in enumerate(tests))), lambda x: x.isNotNull())
    either = reduce(lambda a, b: a | b, tests)
    return edges.filter(either).withColumn("branch", F.explode(passed))


def advice(edges: DataFrame, topic: str, escape: bool = False) -> DataFrame:
    return branches(edges, finds(ADVICE, "node2_id", _told(topic, escape)))


def effects(edges: DataFrame, topic: str, escape: bool = False) -> DataFrame:
    return branches(edges, finds(ADVICE, "node1_id", _told(topic, escape)))


def by_reference(edges: DataFrame, number: str | int, escape: bool = False) -> DataFrame:
    """Advice with the reference, then aspects with it; other kinds don't count."""
    number = _told(number, escape)
    return branches(edges, equals(edges, ADVICE, "reference", number), equals(edges, ASPECT, "reference", number))


def aspects(edges: DataFrame, topic: str, escape: bool = False) -> DataFrame:
    """Aspects that match at their first end, then those that match at their second; those that match at both come twice."""
    topic = _told(topic, escape)
    return branches(edges, finds(ASPECT, "node1_id", topic), finds(ASPECT, "node2_id", topic))


def connected(edges: DataFrame, topic: str, escape: bool = False) -> DataFrame:
    """Advice by first and second end, then aspects by first and second end."""
    topic = _told(topic, escape)
    return branches(edges, *(finds(kind, end, topic) for kind in (ADVICE, ASPECT) for end in ("node1_id", "node2_id")))


def connect_two(edges: DataFrame, one: str, other: str, depth: int | str = 1, escape: bool = False) -> DataFrame:
    """Edges of any kind between exactly two topics, either way round. depth says nothing: only direct edges are found."""
    del depth
    a, b = _told(one, escape), _told(other, escape)
    is_ = lambda end, topic: loose_equal(F.col(end), topic)
    return branches(edges, (is_("node1_id", a) & is_("node2_id", b)) | (is_("node2_id", a) & is_("node1_id", b)))


def likutay(edges: DataFrame, one: str, other: str, depth1: int | str = 1, depth2: int | str = 1, escape: bool = False) -> DataFrame:
    """Edges at exactly the first topic, then those at the second; of those with equal ends and kind the first stays. Depths say nothing."""
    del depth1, depth2
    at = lambda topic: loose_equal(F.col("node1_id"), topic) | loose_equal(F.col("node2_id"), topic)
    hits = branches(edges, at(_told(one, escape)), at(_told(other, escape)))
    key = F.concat_ws("-", js_string(F.col("node1_id")), js_string(F.col("node2_id")), js_string(F.col("type")))
    first = Window.partitionBy("_key").orderBy("branch", "seq")
    # A rank limit keeps one row of a key in each task before the shuffle.
    return hits.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_key", "_n")


def _told(value, escape: bool):
    return escape_quotes(str(value)) if escape else value


QUERIES = {"advice": advice, "effects": effects, "by_reference": by_reference, "aspects": aspects, "connected": connected, "connect_two": connect_two, "likutay": likutay}
