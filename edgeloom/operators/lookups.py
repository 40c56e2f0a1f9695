"""Lists of values to choose from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js_string, truthy
from ..schema import ADVICE, ASPECT

#: A list to choose from holds so many values, the first ones of the dataset.
CAP = 200
#: The lists of the module pages: kinds of edge, properties.
AUTOFILL = {
    "advice": ((ADVICE,), ("node2_id",)),
    "effects": ((ADVICE,), ("node1_id",)),
    "aspects": ((ASPECT,), ("node1_id", "node2_id")),
    "topics": ((ADVICE, ASPECT), ("node1_id", "node2_id")),
    "references": ((ADVICE, ASPECT), ("reference",)),
}


def topics(edges: DataFrame) -> DataFrame:
    """All ids at either end, but for null and empty ones, sorted: value."""
    return edges.select(F.explode(F.array("node1_id", "node2_id")).alias("value")).filter(truthy(F.col("value"))).distinct().orderBy("value")


def references(edges: DataFrame) -> DataFrame:
    """All references, but for null and 0, in numeric order: value."""
    return edges.select(F.col("reference").alias("value")).filter(truthy(F.col("value"), number=True)).distinct().orderBy("value")


def distinct_in_order(rows: DataFrame, value: Column, order: Column) -> DataFrame:
    """Each value once, with the least order at which it occurs: value, first. Null is a value."""
    return rows.groupBy(value.alias("value")).agg(F.min(order).alias("first"))


def autofill(edges: DataFrame, types: tuple[str, ...], properties: tuple[str, ...], cap: int | None = CAP) -> DataFrame:
    """The first cap distinct values of properties of edges of some kinds, in order of first occurrence: value, first.

    first holds seq and the property's place. Null is a value. Values that occur often are reduced before they are shuffled.
    """
    kinds = reduce(lambda a, b: a | b, (F.col("type") == t for t in types))
    spread = edges.filter(kinds).select("seq", F.posexplode(F.array(*properties)).alias("place", "value"))
    # By hash to a number of each value and place; a struct as the least of many rows would have them all sorted.
    least = spread.groupBy("value", "place").agg(F.min("seq").alias("seq"))
    found = distinct_in_order(least, F.col("value"), F.struct("seq", "place")).orderBy("first")
    return found if cap is None else found.limit(cap)


def sorted_lexically(values: DataFrame) -> DataFrame:
    """By text; null sorts as the word null."""
    return values.orderBy(js_string(F.col("value")))


def sorted_numerically(values: DataFrame) -> DataFrame:
    """By number; null sorts as 0."""
    return values.orderBy(F.coalesce(F.col("value"), F.lit(0)))


def complete(values: DataFrame, term: str, least: int = 2) -> DataFrame:
    """The values that hold the term as a literal part, in any case of letters. Terms shorter than least complete nothing."""
    if len(term) < least:
        return values.filter(F.lit(False))
    return values.filter(F.contains(F.lower(F.col("value").cast("string")), F.lower(F.lit(term))))
