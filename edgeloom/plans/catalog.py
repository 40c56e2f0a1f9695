"""The queries that a driver runs over its tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import leading_int
from ..operators import adjacency, graph, layout, live, lookups, module, style
from ..sources import edge_table, write_graph
from ..sources.storage import new_path
from . import sql
from .registry import check_loaded, run

TOPIC, PATTERN, ONE, OTHER, NUMBER = "ring", "^nu", "red plate", "hot ring", 3
HIT = ["seq", "node1_id", "node2_id", "type", "reference"]


def _hits(query, *params, capped=False):
    def ask(spark, sf_dir):
        found = query(edge_table(spark, sf_dir), *params)
        return (live.first_hits(found) if capped else found).select(*HIT, *[c for c in found.columns if c == "branch"])

    return ask


def _over(make):
    return lambda spark, sf_dir: make(edge_table(spark, sf_dir))


def _autofill(name):
    kinds, properties = lookups.AUTOFILL[name]
    return _over(lambda e: lookups.autofill(e, kinds, properties).select("value"))


def _told(e):
    """What is said of a missing topic, of one that isn't there and of one that is."""
    rows = [(k, run(e, "connected", topic).told()) for k, topic in enumerate(("", "nowhere at all", TOPIC))]
    return e.sparkSession.createDataFrame(rows, "place int, text string")


def _from_sink(e):
    """The nodes of a graph that was written and is read again."""
    hits, folder = live.connected(e, TOPIC), new_path(e.sparkSession, "graph")
    write_graph(graph.live_nodes(hits), graph.live_edges(hits, capped=False), folder)
    return e.sparkSession.read.parquet(f"{folder}/nodes")


def _points(e):
    return lookups.topics(e).select("value", F.length("value").cast("double").alias("x"), F.ascii("value").cast("double").alias("y"))


def _chosen(e):
    """The capped hits of `connected`: what a page draws."""
    return live.first_hits(live.connected(e, TOPIC))


def queries() -> dict:
    found = {}
    for name, query in live.QUERIES.items():
        for capped in (False, True):
            found[f"live_{name}" + "_150" * capped] = _hits(query, NUMBER if name == "by_reference" else TOPIC, capped=capped)
    for name, query in module.QUERIES.items():
        params = {"by_reference": (str(NUMBER),), "connect_two": (ONE, OTHER), "likutay": (ONE, OTHER)}.get(name, (TOPIC,))
        found[f"mod_{name}"] = _hits(query, *params)
    found |= {
        "mod_regex_null": _hits(module.advice, PATTERN),
        "mod_find_matches": _over(lambda e: module.find_matches("eitza", "reference", " 0x3 ", e).select(*HIT)),
        "topics_all": _over(lookups.topics),
        "references_all": _over(lookups.references),
        "autofill_text200": _over(lambda e: lookups.autofill(e, ("eitza", "bechina"), ("node1_text", "node2_text")).select("value")),
        "complete_ci": _over(lambda e: lookups.complete(lookups.topics(e), "RiN")),
        "nodes_first_wins": _over(graph.live_nodes),
        "nodes_150": _over(lambda e: graph.live_nodes(_chosen(e))),
        "nodes_last_wins": _over(lambda e: graph.module_nodes(module.connected(e, TOPIC), "he").select("id", "label")),
        "nodes_last_wins_en": _over(lambda e: graph.module_nodes(module.connected(e, TOPIC), "en").select("id", "label")),
        "graph_edges_live": _over(lambda e: graph.live_edges(_chosen(e))),
        "graph_edges_mod": _over(lambda e: graph.module_edges(module.connected(e, TOPIC))),
        "summary": _over(lambda e: graph.summary(live.connected(e, TOPIC))),
        "edge_detail": _over(lambda e: graph.detail(graph.live_edges(_chosen(e)), "e3")),
        "adjacency": _over(adjacency.adjacency),
        "degrees": _over(adjacency.degrees),
        "style_nodes": _over(lambda e: style.style_nodes(graph.module_nodes(module.advice(e, TOPIC), "en").drop("size"), "HOT RING (PROMO)")),
        "style_edges": _over(lambda e: style.style_edges(e).select("seq", "color", "size", "shape", "label", "hover_color")),
        "parallel_rank": _over(lambda e: style.parallel_rank(e).select("seq", "parallel_rank", "parallel_count")),
        "lang_projection": _over(lambda e: style.in_language(e, "en").select("seq", "label1", "label2", "type_name")),
        "label_coalesce": _over(lambda e: e.select("seq", F.coalesce(F.nullif("node2_text", F.lit("")), "node1_id").alias("label"))),
        "auto_curve": _over(lambda e: style.auto_curve(e).select("seq", "type", "prior_type", "curve_place")),
        "curve_styles": _over(lambda e: style.style_edges(style.auto_curve(e)).select("seq", "color", "size", "shape", "label")),
        "parse_int": _over(lambda e: e.select("seq", leading_int(F.substring("proof", 7, 99)).alias("decimal"), leading_int(F.concat(F.lit(" -0X1"), "reference", F.lit("z"))).alias("hexadecimal"), leading_int(F.col("proof")).alias("none"))),
        "sorted_lexically_10": _over(lambda e: lookups.sorted_lexically(lookups.autofill(e, *lookups.AUTOFILL["advice"])).limit(10).select("value")),
        "sorted_numerically_3": _over(lambda e: lookups.sorted_numerically(lookups.autofill(e, *lookups.AUTOFILL["references"])).limit(3).select("value")),
        "mod_escaped": _hits(lambda e, topic: module.advice(e, topic, escape=True), '"?ring'),
        "run_live": _over(lambda e: run(e, "connected", TOPIC).nodes),
        "run_live_uncapped": _over(lambda e: run(e, "connected", TOPIC, cap=None).edges),
        "run_module": _over(lambda e: run(e, "advice", TOPIC, mode="module").nodes),
        "loaded": lambda spark, sf_dir: spark.createDataFrame([(check_loaded(edge_table(spark, sf_dir)),)], "n long"),
        "told": _over(_told),
        "sink_nodes": _over(_from_sink),
        "raw_sql": _over(lambda e: sql.query(e, "SELECT type, count(*) AS n, max(seq) AS last FROM edges WHERE reference = :number GROUP BY type", number=NUMBER)),
        "placed": _over(lambda e: graph.live_nodes(e, seed=7).select("id", (F.col("x").between(0, 100) & F.col("y").between(0, 100) & (F.col("x") != F.col("y"))).alias("inside"))),
        "rescaled": _over(lambda e: layout.rescaled(_points(e), 100.0, 50.0).select("value", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))),
        "bounds": _over(lambda e: layout.bounds(_points(e))),
    }
    return found | {f"autofill_{name}": _autofill(name) for name in lookups.AUTOFILL}


#: The edge view, and seq over it.
_EDGES = """
WITH x AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_returnflag, p.p_name AS node1_id, p.p_name || ' / ' || p.p_brand AS node1_text,
  upper(p.p_name) || ' (' || p.p_type || ')' AS node1_text_en,
  'order ' || CAST(l.l_orderkey AS varchar) || ' line ' || CAST(l.l_linenumber AS varchar) AS proof, CAST(l.l_linenumber AS int) AS reference,
  CASE l.l_returnflag WHEN 'R' THEN 'eitza' WHEN 'A' THEN 'bechina' ELSE 'other' END AS type, CAST(NULL AS int) AS is_good,
  CASE WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'F' AND l.l_linenumber = 1 THEN 1 END AS is_bad
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
e AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS seq, node1_id, lead(node1_id) OVER w AS node2_id, node1_text,
  lead(node1_text) OVER w AS node2_text, proof, reference, type, is_good, is_bad, node1_text_en, lead(node1_text_en) OVER w AS node2_text_en
  FROM x WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag))
"""


def oracle_sql() -> dict[str, str]:
    cols = ", ".join(HIT)
    has = lambda c: f"(coalesce({c}, '') <> '' AND contains({c}, '{TOPIC}'))"
    found_in = lambda c, p=TOPIC: f"regexp_matches(coalesce({c}, 'null'), '{p}')"
    live_where = {
        "advice": f"type = 'eitza' AND {has('node2_id')}",
        "effects": f"type = 'eitza' AND {has('node1_id')}",
        "by_reference": f"reference = {NUMBER}",
        "aspects": f"type = 'bechina' AND ({has('node1_id')} OR {has('node2_id')})",
        "connected": f"{has('node1_id')} OR {has('node2_id')}",
    }
    one_at = f"(node1_id = '{ONE}' OR node2_id = '{ONE}')"
    other_at = f"(node1_id = '{OTHER}' OR node2_id = '{OTHER}')"
    branches = {
        "advice": [f"type = 'eitza' AND {found_in('node2_id')}"],
        "effects": [f"type = 'eitza' AND {found_in('node1_id')}"],
        "by_reference": [f"type = '{t}' AND reference = {NUMBER}" for t in ("eitza", "bechina")],
        "aspects": [f"type = 'bechina' AND {found_in(c)}" for c in ("node1_id", "node2_id")],
        "connected": [f"type = '{t}' AND {found_in(c)}" for t in ("eitza", "bechina") for c in ("node1_id", "node2_id")],
        "connect_two": [f"(node1_id = '{ONE}' AND node2_id = '{OTHER}') OR (node2_id = '{ONE}' AND node1_id = '{OTHER}')"],
        "likutay": [one_at, other_at],
    }
    union = lambda tests: " UNION ALL ".join(f"SELECT *, CAST({k} AS int) AS branch FROM e WHERE {t}" for k, t in enumerate(tests))
    ask = lambda body, more="": f"{_EDGES}{more} {body}"
    sql = {}
    for name, where in live_where.items():
        sql[f"live_{name}"] = ask(f"SELECT {cols} FROM e WHERE {where}")
        sql[f"live_{name}_150"] = ask(f"SELECT {cols} FROM e WHERE {where} ORDER BY seq LIMIT 150")
    for name, tests in branches.items():
        sql[f"mod_{name}"] = ask(f"SELECT {cols}, branch FROM ({union(tests)}) u")
    key = "coalesce(node1_id, 'null'), coalesce(node2_id, 'null'), coalesce(type, 'null')"
    numbered = f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY branch, seq) AS n FROM ({union(branches['likutay'])}) u"
    sql["mod_likutay"] = ask(f"SELECT {cols}, branch FROM ({numbered}) v WHERE n = 1")
    eitza_null = f"type = 'eitza' AND {found_in('node2_id', PATTERN)}"
    sql["mod_regex_null"] = ask(f"SELECT {cols}, branch FROM ({union([eitza_null])}) u")
    sql["mod_find_matches"] = ask(f"SELECT {cols} FROM e WHERE type = 'eitza' AND reference = 3")
    ends = "SELECT node1_id AS value FROM e UNION ALL SELECT node2_id FROM e"
    all_topics = f"SELECT DISTINCT value FROM ({ends}) t WHERE coalesce(value, '') <> ''"
    sql["topics_all"] = ask(all_topics)
    sql["references_all"] = ask("SELECT DISTINCT reference AS value FROM e WHERE coalesce(reference, 0) <> 0")

    def autofill(kinds, properties):
        kind = " OR ".join(f"type = '{k}'" for k in kinds)
        spread = " UNION ALL ".join(f"SELECT {p} AS value, seq, {k} AS place FROM e WHERE {kind}" for k, p in enumerate(properties))
        return ask(f"SELECT value FROM (SELECT value, min(seq * 4 + place) AS f FROM ({spread}) s GROUP BY value ORDER BY f LIMIT 200) t")

    sql |= {f"autofill_{name}": autofill(*what) for name, what in lookups.AUTOFILL.items()}
    sql["autofill_text200"] = autofill(("eitza", "bechina"), ("node1_text", "node2_text"))
    sql["complete_ci"] = ask(f"SELECT value FROM ({all_topics}) a WHERE contains(lower(value), 'rin')")

    first_wins = (
        "SELECT id, label, CAST(3.0 AS double) AS size, '#6cbef4' AS color FROM (SELECT id, coalesce(nullif(text, ''), id) AS label, row_number() OVER (PARTITION BY id ORDER BY seq, side) AS n FROM "
        "(SELECT seq, 0 AS side, node1_id AS id, node1_text AS text FROM {0} UNION ALL SELECT seq, 1, node2_id, node2_text FROM {0}) t WHERE coalesce(id, '') <> '') u WHERE n = 1"
    )
    hits = f", h AS (SELECT * FROM e WHERE {live_where['connected']} ORDER BY seq LIMIT 150)"
    sql["nodes_first_wins"] = ask(first_wins.format("e"))
    sql["nodes_150"] = ask(first_wins.format("h"), hits)
    last_wins = (
        "SELECT id, label FROM (SELECT id, text AS label, row_number() OVER (PARTITION BY id ORDER BY branch DESC, seq DESC, side DESC) AS n FROM "
        "(SELECT branch, seq, 0 AS side, coalesce(node1_id, 'null') AS id, node1_text{0} AS text FROM h UNION ALL SELECT branch, seq, 1, coalesce(node2_id, 'null'), node2_text{0} FROM h) t) u WHERE n = 1"
    )
    mod_hits = f", h AS ({union(branches['connected'])})"
    sql["nodes_last_wins"] = ask(last_wins.format(""), mod_hits)
    sql["nodes_last_wins_en"] = ask(last_wins.format("_en"), mod_hits)
    drawn = (
        "SELECT 'e' || CAST(n AS varchar) AS id, node1_id AS source, node2_id AS target, node1_text, node2_text, proof, reference, CASE WHEN type = 'eitza' THEN '#cf4ac8' ELSE '#999' END AS color, "
        "CAST(1.0 AS double) AS size FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS n FROM h) t WHERE coalesce(node1_id, '') <> '' AND coalesce(node2_id, '') <> ''"
    )
    sql["graph_edges_live"] = ask(drawn, hits)
    sql["graph_edges_mod"] = ask(
        "SELECT row_number() OVER (ORDER BY branch, seq) - 1 AS id, node1_id AS source, node2_id AS target, node1_text_en AS node1_text, node2_text_en AS node2_text, proof, reference, type, is_good, is_bad FROM h", mod_hits
    )
    counted = (
        f"SELECT (SELECT count(DISTINCT value) FROM (SELECT node1_id AS value FROM h UNION ALL SELECT node2_id FROM h) t WHERE coalesce(value, '') <> '') AS nodes, (SELECT count(*) FROM h) AS connections"
    )
    all_hits = f", h AS (SELECT * FROM e WHERE {live_where['connected']})"
    sql["summary"] = ask(f"SELECT nodes, connections, 'Found ' || CAST(nodes AS varchar) || ' nodes, ' || CAST(connections AS varchar) || ' connections' AS text FROM ({counted}) c", all_hits)
    sql["edge_detail"] = ask(
        f"SELECT coalesce(node1_text, '') AS \"from\", coalesce(node2_text, '') AS \"to\", coalesce(proof, '') AS proof, coalesce(CAST(reference AS varchar), '') AS reference FROM ({drawn}) d WHERE id = 'e3'", hits
    )
    either = "CASE WHEN node1_id IS NOT NULL AND node2_id IS NOT NULL THEN type END AS type"
    roles = (
        f", r AS (SELECT node1_id AS id, {either}, node2_id AS other, 'child' AS part FROM e WHERE node1_id IS NOT NULL "
        f"UNION ALL SELECT node2_id, {either}, node1_id, 'parent' FROM e WHERE node2_id IS NOT NULL)"
    )
    tests = {"bechina": "type = 'bechina'", "parent_eitza": "type = 'eitza' AND part = 'parent'", "child_eitza": "type = 'eitza' AND part = 'child'"}
    lists = ", ".join(f"coalesce(list_sort(list(other) FILTER (WHERE {t})), []) AS {c}" for c, t in tests.items())
    sql["adjacency"] = ask(f"SELECT id, {lists} FROM r GROUP BY id", roles)
    sql["degrees"] = ask("SELECT id, " + ", ".join(f"count(*) FILTER (WHERE {t}) AS n_{c}" for c, t in tests.items()) + " FROM r GROUP BY id", roles)
    advice_hits = f", h AS ({union(branches['advice'])})"
    sql["style_nodes"] = ask(f"SELECT id, label, CASE WHEN label = 'HOT RING (PROMO)' THEN '#f5963e' ELSE '#6cbef4' END AS color FROM ({last_wins.format('_en')}) n", advice_hits)
    case = lambda a, b: f"CASE type WHEN 'eitza' THEN {a} WHEN 'bechina' THEN {b} END"
    size = case("CAST(6.1 AS double)", "CAST(2.1 AS double)")
    sql["style_edges"] = ask(f"""SELECT seq, {case("'#cf4ac8'", "'#4acfc8'")} AS color, {size} AS size, {case("'curvedArrow'", "'curve'")} AS shape, {case("'Advice'", "'Aspect'")} AS label, '#000000' AS hover_color FROM e""")
    pair = "CASE WHEN node2_id IS NULL OR node1_id < node2_id THEN node1_id ELSE node2_id END, CASE WHEN node2_id IS NULL OR node1_id >= node2_id THEN node1_id ELSE node2_id END, node2_id IS NULL"
    sql["parallel_rank"] = ask(f"SELECT seq, row_number() OVER (PARTITION BY {pair} ORDER BY seq) - 1 AS parallel_rank, count(*) OVER (PARTITION BY {pair}) AS parallel_count FROM e")
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {pair} ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY {pair}) AS m FROM e"
    sql["auto_curve"] = ask(f"SELECT seq, CASE WHEN m > 1 THEN 'curve' ELSE type END AS type, CASE WHEN m > 1 THEN type END AS prior_type, CASE WHEN m > 1 THEN k END AS curve_place FROM ({ranked}) r")
    sql["curve_styles"] = ask(f"""SELECT seq, {case("'#cf4ac8'", "'#4acfc8'")} AS color, {size} AS size, {case("'curvedArrow'", "'curve'")} AS shape, {case("'Advice'", "'Aspect'")} AS label FROM e""")
    sql["parse_int"] = ask("SELECT seq, CAST(regexp_extract(proof, '^order ([0-9]+)', 1) AS int) AS decimal, CAST(-16 - reference AS int) AS hexadecimal, CAST(NULL AS int) AS none FROM e")
    sql["sorted_lexically_10"] = f"SELECT value FROM ({autofill(*lookups.AUTOFILL['advice'])}) a ORDER BY coalesce(value, 'null') LIMIT 10"
    sql["sorted_numerically_3"] = f"SELECT value FROM ({autofill(*lookups.AUTOFILL['references'])}) a ORDER BY coalesce(value, 0) LIMIT 3"
    sql["mod_escaped"] = ask(f"SELECT {cols}, CAST(0 AS int) AS branch FROM e WHERE type = 'eitza' AND {found_in('node2_id', chr(34) + '?ring')}")
    sql["run_live"] = sql["nodes_150"]
    sql["run_live_uncapped"] = ask(drawn, all_hits)
    sql["run_module"] = ask(f"SELECT id, label, CAST(4.39528751373291 AS double) AS size, 'rgb(55,155,51)' AS color FROM ({last_wins.format('_en')}) n", advice_hits)
    sql["loaded"] = ask("SELECT count(*) AS n FROM e")
    sql["told"] = ask(
        f"SELECT * FROM (VALUES (CAST(0 AS int), 'Please enter a topic'), (CAST(1 AS int), 'No results found')) v(place, text) UNION ALL "
        f"SELECT CAST(2 AS int), 'Found ' || CAST(nodes AS varchar) || ' nodes, ' || CAST(connections AS varchar) || ' connections' FROM ({counted}) c", hits
    )
    sql["sink_nodes"] = ask(first_wins.format("h"), all_hits)
    sql["raw_sql"] = ask(f"SELECT type, count(*) AS n, max(seq) AS last FROM e WHERE reference = {NUMBER} GROUP BY type")
    sql["placed"] = ask(f"SELECT value AS id, true AS inside FROM ({all_topics}) a")
    sql["rescaled"] = ask(
        f"SELECT value, round((x - (max_x + min_x) / 2) * scale, 6) AS x, round((y - (max_y + min_y) / 2) * scale, 6) AS y FROM (SELECT *, least(100 / (max_x - min_x), 50 / (max_y - min_y)) AS scale FROM "
        f"(SELECT *, max(x) OVER () AS max_x, min(x) OVER () AS min_x, max(y) OVER () AS max_y, min(y) OVER () AS min_y FROM "
        f"(SELECT value, CAST(length(value) AS double) AS x, CAST(ascii(value) AS double) AS y FROM ({all_topics}) a) b) c) d"
    )
    sql["lang_projection"] = ask(f"""SELECT seq, node1_text_en AS label1, node2_text_en AS label2, {case("'Advice'", "'Aspect'")} AS type_name FROM e""")
    sql["label_coalesce"] = ask("SELECT seq, coalesce(nullif(node2_text, ''), node1_id) AS label FROM e")
    sql["bounds"] = ask(
        f"SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM (SELECT CAST(length(value) AS double) AS x, CAST(ascii(value) AS double) AS y FROM ({all_topics}) a) b"
    )
    return sql
