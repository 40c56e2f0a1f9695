"""How nodes and edges look, and the words of the pages in two languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import escape_quotes
from ..schema import ADVICE, ASPECT

#: Colors, sizes, shapes and names.
NODE_COLOR, CHOSEN_COLOR, HOVER_COLOR = "#6cbef4", "#f5963e", "#000000"
EDGE_STYLES = {
    ASPECT: ("#4acfc8", 2.1, "curve", {"en": "Aspect", "he": "בחינה"}),
    ADVICE: ("#cf4ac8", 6.1, "curvedArrow", {"en": "Advice", "he": "עצה"}),
}


#: The names of the queries and what the pages say around them, of the literal and of the pattern pages.
LIVE_WORDS = {
    "en": {"run": "Run Search", "advice": "Get Advice", "effects": "Get Effects", "by_reference": "Search By Torah", "aspects": "Get Bechinos", "connected": "Get All Connected"},
    "he": {"run": "חפש", "advice": "קבל עצה", "effects": "קבל נמשך", "by_reference": "חפש לפי תורה", "aspects": "בחינות", "connected": "כל הקשורים"},
}
MODULE_WORDS = {
    "en": {
        "run": "Run Search", "advice": "Get Advice", "effects": "Get Effects", "by_reference": "Search By Torah", "aspects": "Get Bechinos",
        "connected": "Get All Connected Topics", "connect_two": "Connect Two Bechinos", "likutay": "Likutay Halachos Style", "raw": "Raw Query",
        "topic": "Select Topic:", "topic_1": "Select Topic 1:", "topic_2": "Select Topic 2:", "reference": "Select Torah #:", "depth_2": "Select Depth 2:",
    },
    "he": {
        "run": "חפש", "advice": "קבל עצה", "effects": "קבל נמשך (מסובב)", "by_reference": "חפש לפי תורה", "aspects": "בחינות",
        "connected": "קבל כל הנושאים הקשורים", "connect_two": "קשר ב' בחינות", "likutay": "חידושים בסיגנון לקוטי הלכות", "raw": "חפש עם קוד",
        "topic": "בחר נושא", "topic_1": "בחר נושא 1", "topic_2": "בחר נושא 2", "reference": "מספר תורה", "depth_2": "בחר עומק 2",
    },
}


def query_name(query: str, lang: str = "en", mode: str = "live") -> str:
    """What a page calls a query, or says at an input, in a language."""
    return (LIVE_WORDS if mode == "live" else MODULE_WORDS)[lang][query]


def style_nodes(nodes: DataFrame, *topics: str, escape: bool = True) -> DataFrame:
    """nodes in the color for all, and those whose label is a topic asked for in the color for these."""
    wanted = [escape_quotes(str(t)) if escape else str(t) for t in topics]
    chosen = F.coalesce(F.col("label").isin(wanted), F.lit(False)) if wanted else F.lit(False)
    return nodes.withColumn("color", F.when(chosen, CHOSEN_COLOR).otherwise(NODE_COLOR))


def style_edges(edges: DataFrame, lang: str = "en") -> DataFrame:
    """edges with color, size, shape, label and hover_color by kind. The kind is type, or else prior_type where a column of that name is; other kinds have none of
    these but the hover color. An edge of both kinds looks like advice."""
    kinds = [F.col(c) for c in ("type", "prior_type") if c in edges.columns]

    def by_kind(place: int):
        value = lambda kind: F.lit(EDGE_STYLES[kind][place][lang] if place == 3 else EDGE_STYLES[kind][place])
        is_ = lambda kind: F.greatest(*(F.coalesce(k == kind, F.lit(False)) for k in [*kinds, F.lit(None)]))
        return F.when(is_(ADVICE), value(ADVICE)).when(is_(ASPECT), value(ASPECT))

    return edges.withColumns({"color": by_kind(0), "size": by_kind(1), "shape": by_kind(2), "label": by_kind(3), "hover_color": F.lit(HOVER_COLOR)})


def parallel_rank(edges: DataFrame, order: str = "seq", ends: tuple[str, str] = ("node1_id", "node2_id")) -> DataFrame:
    """edges with their place from 0 among those between the same two nodes, either way round, and the number of these: parallel_rank, parallel_count.
    Edges with a missing end stand alone with the same end or ends missing."""
    pair = [F.least(*ends), F.greatest(*ends), F.col(ends[0]).isNull() | F.col(ends[1]).isNull()]
    rank = F.row_number().over(Window.partitionBy(*pair).orderBy(order)) - 1
    return edges.withColumns({"parallel_rank": rank.cast("long"), "parallel_count": F.count(F.lit(1)).over(Window.partitionBy(*pair))})


def auto_curve(edges: DataFrame, order: str = "seq", ends: tuple[str, str] = ("node1_id", "node2_id")) -> DataFrame:
    """edges, of which those that share their two nodes with others are drawn as curves: their kind moves to prior_type (null for all others), type becomes `curve`, and
    curve_place is their place among them. style_edges() looks at both columns, so the kinds keep their looks."""
    ranked = parallel_rank(edges, order, ends)
    several = F.col("parallel_count") > 1
    return ranked.withColumns({
        "prior_type": F.when(several, F.col("type")),
        "type": F.when(several, "curve").otherwise(F.col("type")),
        "curve_place": F.when(several, F.col("parallel_rank")),
    }).drop("parallel_rank", "parallel_count")


def in_language(edges: DataFrame, lang: str = "en") -> DataFrame:
    """edges with the labels of one language as label1 and label2, and the name of their kind as type_name."""
    one, two = ("node1_text", "node2_text") if lang == "he" else ("node1_text_en", "node2_text_en")
    names = F.create_map(*(F.lit(x) for kind, style in EDGE_STYLES.items() for x in (kind, style[3][lang])))
    return edges.withColumns({"label1": F.col(one), "label2": F.col(two), "type_name": F.try_element_at(names, F.col("type"))})
