"""Extension: queries in SQL over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame


def register(edges: DataFrame, name: str = "edges") -> None:
    """The edges as a view of the session; one of the same name is replaced."""
    edges.createOrReplaceTempView(name)


def query(edges: DataFrame, text: str, name: str = "edges", **params) -> DataFrame:
    """A SQL query over the edges as view `name`. Parameters stand as :name in it and never become part of its text."""
    register(edges, name)
    return edges.sparkSession.sql(text, args=params or None)
