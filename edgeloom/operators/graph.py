"""Hits as a graph: nodes with labels, edges with ids, a summary, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import default_to, js_string, truthy
from ..schema import ADVICE
from .numbering import with_positions

#: How graphs are drawn.
LIVE_NODE_SIZE, LIVE_NODE_COLOR = 3.0, "#6cbef4"
MODULE_NODE_SIZE, MODULE_NODE_COLOR = 4.39528751373291, "rgb(55,155,51)"
ADVICE_COLOR, PLAIN_COLOR = "#cf4ac8", "#999"


def text_columns(lang: str) -> tuple[str, str]:
    """The columns of labels in a language: `he`, the original, or `en`."""
    if lang not in ("he", "en"):
        raise ValueError(f"no labels in {lang}")
    return ("node1_text", "node2_text") if lang == "he" else ("node1_text_en", "node2_text_en")


def _order(hits: DataFrame) -> list[str]:
    return ["branch", "seq"] if "branch" in hits.columns else ["seq"]


def _ends(hits: DataFrame, texts: tuple[str, str]) -> DataFrame:
    """A row for each end of each hit: order columns, side, id, text."""
    end = lambda n: F.struct(F.lit(n - 1).alias("side"), F.col(f"node{n}_id").alias("id"), F.col(texts[n - 1]).alias("text"))
    return hits.select(*_order(hits), F.inline(F.array(end(1), end(2))))


def _labelled(ends: DataFrame, label: Column, last: bool) -> DataFrame:
    """id, label of the first or last of ends. Spark reduces by hash only to values of a fixed width, and sorts all rows to choose a text: so the first or last seq of each
    label of an id is found by hash, and few rows are left to choose from."""
    order = [c for c in ("branch", "seq", "side") if c in ends.columns]
    found = ends.groupBy("id", label.alias("label"), *[c for c in order if c != "seq"]).agg((F.max if last else F.min)("seq").alias("seq"))
    return found.groupBy("id").agg((F.max_by if last else F.min_by)("label", F.struct(*order)).alias("label"))


def live_nodes(hits: DataFrame, seed: int | None = None) -> DataFrame:
    """The ids at hits' ends but for null and empty ones: id, label (of the first occurrence; the id, if that has no text), size, color.
    seed: with random x and y from 0 to 100."""
    ends = _ends(hits, text_columns("he")).filter(truthy(F.col("id")))
    nodes = _labelled(ends, default_to(F.col("text"), F.col("id")), last=False).withColumns({"size": F.lit(LIVE_NODE_SIZE), "color": F.lit(LIVE_NODE_COLOR)})
    return nodes if seed is None else placed(nodes, seed, 100.0)


def module_nodes(hits: DataFrame, lang: str = "en", seed: int | None = None) -> DataFrame:
    """The ids at hits' ends, null as the word null: id, label (of the last occurrence, null if that has none), size, color.
    seed: with random x and y from 0 to 1."""
    ends = _ends(hits, text_columns(lang)).withColumn("id", js_string(F.col("id")))
    nodes = _labelled(ends, F.col("text"), last=True).withColumns({"size": F.lit(MODULE_NODE_SIZE), "color": F.lit(MODULE_NODE_COLOR)})
    return nodes if seed is None else placed(nodes, seed, 1.0)


def placed(nodes: DataFrame, seed: int, side: float) -> DataFrame:
    """nodes with random x and y below side; the same seed and id give the same place, however nodes are dealt to tasks."""
    share = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40)
    return nodes.withColumns({"x": share(0) * side, "y": share(1) * side})


def live_edges(hits: DataFrame, capped: bool = True) -> DataFrame:
    """Hits with two ends that aren't null or empty, as drawn. Ids are `e` and the place among all hits, so they have gaps.
    capped: hits are few and are numbered in one task; else they are numbered in ranges."""
    placed = hits.withColumn("_place", F.row_number().over(Window.orderBy("seq")) - 1) if capped else with_positions(hits, ["seq"], "_place")
    numbered = placed.withColumn("id", F.concat(F.lit("e"), F.col("_place").cast("string")))
    return numbered.filter(truthy(F.col("node1_id")) & truthy(F.col("node2_id"))).select(
        "id",
        F.col("node1_id").alias("source"),
        F.col("node2_id").alias("target"),
        "node1_text",
        "node2_text",
        "proof",
        "reference",
        F.when(F.col("type") == ADVICE, ADVICE_COLOR).otherwise(PLAIN_COLOR).alias("color"),
        F.lit(1.0).alias("size"),
    )


def module_edges(hits: DataFrame, lang: str = "en") -> DataFrame:
    """All hits, with their place in the order (branch, seq) as id and labels in one language."""
    one, two = text_columns(lang)
    return with_positions(hits, ["branch", "seq"], "id").select(
        "id",
        F.col("node1_id").alias("source"),
        F.col("node2_id").alias("target"),
        F.col(one).alias("node1_text"),
        F.col(two).alias("node2_text"),
        "proof",
        "reference",
        "type",
        "is_good",
        "is_bad",
    )


def summary(hits: DataFrame, mode: str = "live") -> DataFrame:
    """One row: nodes, connections, text. Hits count as connections even if an end is missing."""
    ends = _ends(hits, text_columns("he"))
    ends = ends.withColumn("id", F.when(truthy(F.col("id")), F.col("id")) if mode == "live" else js_string(F.col("id")))
    counted = ends.agg(F.countDistinct("id").alias("nodes"), F.sum(1 - F.col("side")).alias("connections"))
    counted = counted.withColumn("connections", F.coalesce("connections", F.lit(0)).cast("long"))
    text = F.concat(F.lit("Found "), F.col("nodes").cast("string"), F.lit(" nodes, "), F.col("connections").cast("string"), F.lit(" connections"))
    return counted.withColumn("text", text)


def detail(edges: DataFrame, edge_id: Column | str | int) -> DataFrame:
    """What a click on a drawn edge shows: from, to, proof, reference; nothing is null, but empty."""
    wanted = edge_id if isinstance(edge_id, Column) else F.lit(edge_id)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return edges.filter(F.col("id") == wanted).select(
        shown("node1_text").alias("from"), shown("node2_text").alias("to"), shown("proof").alias("proof"), shown("reference").alias("reference")
    )
