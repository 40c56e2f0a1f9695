"""Queries by literal text: one pass over the edges, hits in the order of the dataset, usually cut to the first CAP.

Every query is one filter, so it reaches the scan; a topic is matched as a case-sensitive literal part of an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contains_literal, leading_int, truthy
from ..schema import ADVICE, ASPECT

#: A query's hits beyond this many, in the order of the dataset, aren't shown.
CAP = 150


class TopicMissing(ValueError):
    """A query that needs a topic got an empty one."""

    def __init__(self):
        super().__init__("Please enter a topic")


def _has(column: str, topic: str) -> Column:
    if not topic:
        raise TopicMissing
    return truthy(F.col(column)) & contains_literal(F.col(column), topic)


def advice(edges: DataFrame, topic: str) -> DataFrame:
    """Advice that leads to the topic."""
    return edges.filter((F.col("type") == ADVICE) & _has("node2_id", topic))


def effects(edges: DataFrame, topic: str) -> DataFrame:
    """What the topic, as advice, leads to."""
    return edges.filter((F.col("type") == ADVICE) & _has("node1_id", topic))


def by_reference(edges: DataFrame, number: str | int) -> DataFrame:
    """Edges of any kind with a reference. A string counts by the whole number that it starts with; without one nothing is found."""
    wanted = leading_int(number) if isinstance(number, str) else int(number)
    return edges.filter(F.lit(False) if wanted is None else F.col("reference") == F.lit(wanted))


def aspects(edges: DataFrame, topic: str) -> DataFrame:
    """Aspects with the topic at either end, each once."""
    return edges.filter((F.col("type") == ASPECT) & (_has("node1_id", topic) | _has("node2_id", topic)))


def connected(edges: DataFrame, topic: str) -> DataFrame:
    """Edges of any kind with the topic at either end, each once."""
    return edges.filter(_has("node1_id", topic) | _has("node2_id", topic))


def first_hits(hits: DataFrame, cap: int = CAP) -> DataFrame:
    """The first hits of the dataset, by seq: each partition keeps its own first ones before they meet."""
    return hits.orderBy("seq").limit(cap)


QUERIES = {"advice": advice, "effects": effects, "by_reference": by_reference, "aspects": aspects, "connected": connected}
