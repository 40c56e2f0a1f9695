"""Queries by name, from parameters to a drawn graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import graph, live, module, style

#: What a query tells besides its result.
NO_TOPIC, NOTHING_FOUND, FOUND = "Please enter a topic", "No results found", "Found"


@dataclass
class GraphResult:
    """hits: the edges found, in seq (and branch) order. nodes, edges: as drawn. summary: one row of counts. status: NO_TOPIC, or None
    where only running the query tells; see told()."""

    hits: DataFrame
    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame
    status: str | None = None

    def told(self) -> str:
        """The line shown to the user."""
        if self.status:
            return self.status
        row = self.summary.first()
        return row.text if row.connections else NOTHING_FOUND


def run(edges: DataFrame, query: str, *params, mode: str = "live", cap: int | None = live.CAP, lang: str = "en", escape: bool = True, styled: bool = False) -> GraphResult:
    """A query by name, with its parameters.

    mode `live`: by literal text, cut to the first cap hits (None: all; they are then numbered in ranges). mode `module`: by pattern, without a cap; escape says whether
    parameters get backslashes before quotation marks first, as the pages do. styled: colors and shapes of the module pages.
    A missing topic gives an empty result with a status in live mode and an empty result in module mode.
    """
    if mode not in ("live", "module"):
        raise ValueError(f"no such mode: {mode}")
    known = live.QUERIES if mode == "live" else module.QUERIES
    if query not in known:
        raise ValueError(f"no such query in mode {mode}: {query}")
    if mode == "module":
        hits = known[query](edges, *params, escape=escape)
        nodes, drawn = graph.module_nodes(hits, lang), graph.module_edges(hits, lang)
        if styled:
            nodes, drawn = style.style_nodes(nodes, *[p for p in params if isinstance(p, str)][:2], escape=escape), style.style_edges(drawn, lang)
        return GraphResult(hits, nodes, drawn, graph.summary(hits, "module"))
    status = None
    try:
        hits = known[query](edges, *params)
    except live.TopicMissing:
        hits, status = edges.limit(0), NO_TOPIC
    hits = hits if cap is None else live.first_hits(hits, cap)
    return GraphResult(hits, graph.live_nodes(hits), graph.live_edges(hits, capped=cap is not None), graph.summary(hits), status)


def check_loaded(edges: DataFrame) -> int:
    """The number of edges; an error if the dataset has none."""
    n = edges.count()
    if not n:
        raise ValueError("the dataset has no edges")
    return n
