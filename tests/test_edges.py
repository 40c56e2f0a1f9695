import json

import pytest
from edge_rows import LIVE, MODULE, NAMES, REFERENCES, ROWS
from pyspark.sql import functions as F

from edgeloom import sources
from edgeloom.functions import scalar
from edgeloom.operators import adjacency, graph, layout, live, lookups, module, numbering, style
from edgeloom.plans import check_loaded, extensions, run, sql
from edgeloom.schema import EDGES
from edgeloom.sources import edge_table, read_assignment, read_parquet, write_graph


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(ROWS, EDGES).repartition(3).cache()


def seqs(hits):
    order = ["branch", "seq"] if "branch" in hits.columns else ["seq"]
    return [r.seq for r in hits.orderBy(*order).collect()]


@pytest.mark.parametrize("topic", LIVE)
def test_live_queries(edges, topic):
    assert tuple(seqs(live.QUERIES[n](edges, topic)) for n in NAMES) == LIVE[topic]


@pytest.mark.parametrize("topic", MODULE)
def test_module_queries(edges, topic):
    assert tuple(seqs(module.QUERIES[n](edges, topic, escape=True)) for n in NAMES) == MODULE[topic]


def test_bad_pattern_raises(edges):
    with pytest.raises(Exception, match="(?i)regex|pattern"):
        module.advice(edges, "(").collect()


@pytest.mark.parametrize("number", REFERENCES)
def test_by_reference(edges, number):
    first, then = REFERENCES[number]
    assert seqs(live.by_reference(edges, number)) == seqs(live.by_reference(edges, f" {number}x")) == first
    assert seqs(module.by_reference(edges, number)) == seqs(module.by_reference(edges, f" {number}.0 ")) == then
    assert seqs(live.by_reference(edges, "")) == seqs(module.by_reference(edges, f"{number}x")) == []


def test_two_topics(edges):
    assert seqs(module.connect_two(edges, "joy", "faith")) == seqs(module.connect_two(edges, "faith", "joy", depth=3)) == [0, 1, 3]
    assert seqs(module.connect_two(edges, "humility", "humility")) == [4]
    assert seqs(module.connect_two(edges, 'the "king"', "joy")) == [5]
    assert seqs(module.connect_two(edges, 'the "king"', "joy", escape=True)) == []
    assert seqs(module.likutay(edges, "faith", "joy")) == [0, 1, 8, 2, 5, 7, 9]
    assert seqs(module.likutay(edges, "peace", "humility")) == [9, 4]


def test_find_matches(edges):
    assert seqs(module.find_matches("eitza", "node1_id", "joy", edges)) == [0, 3]
    assert seqs(module.find_matches("bechina", "reference", "0x2", edges)) == [2, 6]
    assert seqs(module.find_matches_regex("bechina", "node1_id", "", edges)) == []


def test_lists(edges):
    filled = {n: [r.value for r in lookups.autofill(edges, *what).collect()] for n, what in lookups.AUTOFILL.items()}
    assert filled == {
        "advice": ["faith", "joy"],
        "effects": ["joy", 'the "king"', None],
        "aspects": ["faith", "joy", "joyful song", "humility", "a.b", "axb", None],
        "topics": ["joy", "faith", "joyful song", "humility", 'the "king"', "a.b", "axb", None],
        "references": [1, 2, 10, 3, None],
    }
    assert [r.value for r in lookups.autofill(edges, *lookups.AUTOFILL["aspects"], cap=3).collect()] == ["faith", "joy", "joyful song"]
    assert [r.value for r in lookups.topics(edges).collect()] == ["a.b", "axb", "faith", "humility", "joy", "joyful song", "peace", 'the "king"']
    assert [r.value for r in lookups.references(edges).collect()] == [1, 2, 3, 10]
    assert {r.value for r in lookups.complete(lookups.topics(edges), "JO").collect()} == {"joy", "joyful song"}
    assert not lookups.complete(lookups.topics(edges), "j").collect()
    assert [r.value for r in lookups.sorted_numerically(lookups.autofill(edges, *lookups.AUTOFILL["references"])).collect()] == [None, 1, 2, 3, 10]
    assert [r.value for r in lookups.sorted_lexically(lookups.autofill(edges, *lookups.AUTOFILL["effects"])).collect()] == ["joy", None, 'the "king"']


def test_live_graph(edges):
    got = run(edges, "connected", "joy")
    assert {r.id: r.label for r in got.nodes.collect()} == {"joy": "Joy#1", "faith": "Faith#1", "joyful song": "Song", 'the "king"': "King", "peace": "Peace"}
    assert {r.id: r.proof for r in got.edges.collect()} == {"e0": "p0", "e1": "p1", "e2": "p2", "e3": "p3", "e4": "p5", "e6": "p9"}
    assert got.told() == "Found 5 nodes, 7 connections"
    assert run(edges, "connected", "").told() == "Please enter a topic"
    assert run(edges, "advice", "nowhere").told() == "No results found"
    assert seqs(run(edges, "connected", "joy", cap=2).hits) == [0, 1]
    assert [tuple(r) for r in graph.detail(got.edges, "e6").collect()] == [("", "Peace", "p9", "1")]
    placed = graph.live_nodes(got.hits, seed=1)
    assert {tuple(r) for r in placed.collect()} == {tuple(r) for r in graph.live_nodes(got.hits.repartition(5), seed=1).collect()}
    assert all(0 <= r.x < 100 and 0 <= r.y < 100 for r in placed.collect())


def test_module_graph(edges):
    hits = module.connected(edges, "joy")
    assert {r.id: r.label for r in graph.module_nodes(hits, "he").collect()} == {"joy": "Joy#3", "faith": "Faith#2", 'the "king"': "King", "null": None, "joyful song": "Song"}
    assert [(r.id, r.proof) for r in graph.module_edges(hits).orderBy("id").collect()] == list(enumerate(["p0", "p3", "p5", "p7", "p2", "p1", "p2"]))
    assert graph.summary(hits, "module").first().nodes == 5
    styled = run(edges, "effects", "joy", mode="module", lang="he", styled=True)
    assert {r.color for r in styled.edges.collect()} == {"#cf4ac8"}
    with pytest.raises(ValueError):
        run(edges, "raw", "joy")


@pytest.mark.parametrize("make", [lambda e: graph.module_nodes(module.connected(e, "joy")), graph.live_nodes, lambda e: lookups.autofill(e, *lookups.AUTOFILL["topics"])])
def test_labels_are_reduced_before_a_sort(spark, make):
    """Rows as many as the hits go through hash aggregates only; a sort sees one row for each label of an id, or each place of a value."""
    plan = make(spark.createDataFrame(ROWS, EDGES))._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Aggregate" in x]
    assert "HashAggregate" in lines[-1] and "HashAggregate" in lines[-2] and not any("Sort" in x for x in lines[-2:])


def test_labels_of_ties(spark):
    """First and last by branch, then seq, then side; seq of any size, texts repeated, null and empty."""
    big = 1 << 62
    rows = [(big + k, "a", "a", f"t{k % 3}" if k % 4 else None, "" if k % 5 == 0 else f"u{k % 2}", None, 1, "eitza", None, None, f"e{k % 3}" if k != 39 else None, f"f{k}" if k < 39 else None) for k in range(-40, 40)]
    table = spark.createDataFrame(rows, EDGES).repartition(7)
    assert [tuple(r) for r in graph.live_nodes(table).select("id", "label").collect()] == [("a", "a")]
    assert [r.label for r in graph.live_nodes(table.filter(F.col("seq") > big - 40)).collect()] == [f"t{-39 % 3}"]
    assert [r.label for r in graph.module_nodes(table.withColumn("branch", F.lit(0))).collect()] == [None]
    two = table.withColumn("branch", (F.col("seq") < big).cast("int"))
    assert [r.label for r in graph.module_nodes(two).collect()] == ["f-1"]
    assert [r.label for r in graph.live_nodes(two).collect()] == ["a"] and [r.label for r in graph.module_nodes(two, "he").collect()] == ["u1"]


def test_adjacency(edges):
    got = {r.id: (r.bechina, r.parent_eitza, r.child_eitza) for r in adjacency.adjacency(edges, "js").collect()}
    assert got == {
        "joy": (["faith", "joyful song"], ["null", 'the "king"'], ["faith", "faith"]),
        "faith": (["joy", "null"], ["joy", "joy"], []),
        "joyful song": (["joy"], [], []),
        "humility": (["humility", "humility"], [], []),
        'the "king"': ([], [], ["joy"]),
        "a.b": (["axb"], [], []),
        "axb": (["a.b"], [], []),
        "null": (["faith"], [], ["joy"]),
        "peace": ([], [], []),
    }
    plain = adjacency.adjacency(edges).collect()
    assert {r.id for r in plain} == got.keys() - {"null"}
    assert {r.id for r in adjacency.adjacency(edges.filter("seq in (7, 8)")).collect()} == {"joy", "faith"}
    assert sum(len(r.bechina) for r in plain) == 2 * 4 and sum(len(r.child_eitza) for r in plain) == sum(len(r.parent_eitza) for r in plain) == 3
    assert {r.id: r.n_bechina for r in adjacency.degrees(edges).collect()} == {r.id: len(r.bechina) for r in plain}


def test_adjacency_counts_before_the_shuffle(spark):
    """Repeated neighbours are shuffled once for each task, and lists hold each of them, in order."""
    rows = [(k, f"n{k % 3}", f"m{k * k % 5}", "", "", "", 1, ("eitza", "bechina")[k % 2], None, None, "", "") for k in range(2000)]
    table = spark.createDataFrame(rows, EDGES).repartition(3)
    got = {r.id: (r.bechina, r.parent_eitza, r.child_eitza) for r in adjacency.adjacency(table).collect()}
    want = {}
    for _, a, b, *_, kind, _, _, _, _ in rows:
        for own, other, at in ((a, b, 2), (b, a, 1)):
            want.setdefault(own, ([], [], []))[at if kind == "eitza" else 0].append(other)
    assert got == {k: tuple(map(sorted, v)) for k, v in want.items()}
    plan = adjacency.adjacency(spark.createDataFrame(ROWS, EDGES))._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Aggregate" in x or "Exchange" in x]
    assert "HashAggregate" in lines[-1] and "ObjectHash" not in lines[-1] and "Exchange" in lines[-2]


def test_styles(edges, spark):
    nodes = spark.createDataFrame([("a", 'the \\"king\\"'), ("b", 'the "king"'), ("c", None)], "id string, label string")
    assert [r.color for r in style.style_nodes(nodes, 'the "king"').orderBy("id").collect()] == ["#f5963e", "#6cbef4", "#6cbef4"]
    assert [r.color for r in style.style_nodes(nodes, 'the "king"', escape=False).orderBy("id").collect()] == ["#6cbef4", "#f5963e", "#6cbef4"]
    kinds = spark.createDataFrame([(0, "curve", "eitza"), (1, "bechina", None), (2, "other", None)], "seq long, type string, prior_type string")
    assert [(r.color, r.size, r.shape, r.label) for r in style.style_edges(kinds, "he").orderBy("seq").collect()] == [("#cf4ac8", 6.1, "curvedArrow", "עצה"), ("#4acfc8", 2.1, "curve", "בחינה"), (None,) * 4]
    ranks = {r.seq: (r.parallel_rank, r.parallel_count) for r in style.parallel_rank(edges).collect()}
    assert [ranks[k] for k in (0, 1, 3, 4)] == [(0, 3), (1, 3), (2, 3), (0, 1)]
    curved = {r.seq: (r.type, r.prior_type, r.curve_place) for r in style.auto_curve(edges).collect()}
    assert [curved[k] for k in (0, 1, 3, 4)] == [("curve", "eitza", 0), ("curve", "bechina", 1), ("curve", "eitza", 2), ("bechina", None, None)]
    assert {r.seq: r.color for r in style.style_edges(style.auto_curve(edges)).collect()} == {r.seq: r.color for r in style.style_edges(edges).collect()}
    assert style.query_name("connected", "en", "module") == "Get All Connected Topics" and style.query_name("connected", "he") == "כל הקשורים"
    assert style.in_language(edges, "en").filter("seq = 9").first().type_name is None


def test_scalars(spark):
    assert [scalar.as_number(x) for x in ("", " 01 ", "1.0", "1e0", "0x1", "1 2", "abc", "-Infinity", "1_0", ".5", "5.")] == [0, 1, 1, 1, 1, None, None, float("-inf"), None, 0.5, 5]
    assert [scalar.leading_int(x) for x in ("12abc", "", " -3", "0x1f", "x")] == [12, None, -3, 31, None]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("12abc",), ("",), (None,), ("99999999999",)], "s string").select(scalar.leading_int(F.col("s")).alias("n"))
    assert [r.n for r in rows.collect()] == [12, None, None, None]
    forms = ["0x1f!", " -0X10", "\ufeff\u00a07", "\u0663", "0x", "0xffffffffffffffffff", "-", "+5", "0x0000000000000000012"]
    rows = spark.createDataFrame([(f,) for f in forms], "s string").select(scalar.leading_int(F.col("s")).alias("n"))
    assert [r.n for r in rows.collect()] == [31, -16, 7, None, 0, None, None, 5, 18]
    assert [scalar.leading_int(f) for f in forms] == [31, -16, 7, None, 0, 16**18 - 1, None, 5, 18]
    assert scalar.as_number("\u0663") is None and scalar.as_number("\ufeff3") == 3
    assert scalar.escape_quotes("a\"b'c") == "a\\\"b\\'c"


@pytest.mark.parametrize("few", [numbering.FEW, 10])
def test_positions(spark, monkeypatch, few):
    monkeypatch.setattr(numbering, "FEW", few)
    rows = spark.range(5000).selectExpr("cast(id % 3 as int) g", "cast(case when id < 3000 then 7 else id * id end as long) o")
    got = [(r.g, r.o) for r in numbering.with_positions(rows, ["g", "o"]).orderBy("position").collect()]
    assert got == sorted(got) and len(got) == 5000
    assert sorted(r.position for r in numbering.with_positions(rows, ["o"]).collect()) == list(range(5000))
    assert not numbering.with_positions(rows.limit(0), ["g", "o"]).collect()


def test_edge_table(spark, tmp_path):
    """Keys of any size keep their order, and the stored table is by type."""
    lines = [(9_000_000_000 + k // 3, 1 + k % 3, 10**12 + k, 10**9, "RAN"[k % 3], "F") for k in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(x[2], f"p{x[2] - 10**12}", "B", "T") for x in lines], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    table = edge_table(spark, str(tmp_path))
    assert table.schema == EDGES
    got = table.orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(60)) and [r.node1_id for r in got] == [f"p{k}" for k in range(60)]
    assert [r.node2_id for r in got] == [f"p{k + 1}" if k % 3 < 2 else None for k in range(60)]
    assert "type" in live.advice(table, "p")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    assert edge_table(spark, str(tmp_path)).inputFiles() == table.inputFiles()


@pytest.mark.parametrize("broadcast", [sources.edges.BROADCAST_PARTS, 10])
def test_edge_table_in_ranges(spark, tmp_path, monkeypatch, broadcast):
    """As many ranges as the rows need, whatever the number of shuffle partitions; rows are sorted for the last time there, and a file holds seq in order."""
    monkeypatch.setattr(numbering, "RANGE_ROWS", 30)
    monkeypatch.setattr(sources.edges, "BROADCAST_PARTS", broadcast)
    lines = [(k // 3, 1 + k % 3, k % 50, 1, "RANA"[k % 4], "F") for k in range(600)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"p{k}", "B", "t") for k in range(50)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    table = edge_table(spark, str(tmp_path))
    got = [tuple(r) for r in table.orderBy("seq").collect()]
    part = lambda k: (f"p{lines[k][2]}", f"p{lines[k][2]} / B", f"P{lines[k][2]} (t)") if k < 600 and k % 3 else (None,) * 3
    own = lambda k: (f"p{lines[k][2]}", f"p{lines[k][2]} / B", f"P{lines[k][2]} (t)")
    kinds = {"R": "eitza", "A": "bechina", "N": "other"}
    for k, (seq, a, b, ta, tb, proof, reference, kind, good, bad, ea, eb) in enumerate(got):
        assert (seq, a, ta, ea) == (k, *own(k)) and (b, tb, eb) == part(k + 1)
        assert (proof, reference, kind, good, bad) == (f"order {k // 3} line {1 + k % 3}", 1 + k % 3, kinds[lines[k][4]], None, 1 if lines[k][4] == "A" and k % 3 == 0 else None)
    assert len(got) == 600
    rows = {}
    for r in table.select(F.input_file_name().alias("file"), "seq").collect():
        rows.setdefault(r.file, []).append(r.seq)
    assert len(rows) > 3 * 10 and all(x == sorted(x) for x in rows.values())


def test_files(spark, edges, tmp_path):
    records = [{f.name: row[k + 1] for k, f in enumerate(EDGES.fields[1:])} for row in ROWS]
    one, two = tmp_path / "one.js", tmp_path / "two.js"
    one.write_text("edges1 = " + json.dumps(records[:6], ensure_ascii=False, indent=1) + "\n", encoding="utf-8")
    two.write_text("﻿var edges2 = " + json.dumps(records[6:]) + ";\n", encoding="utf-8")
    assert [tuple(r) for r in read_assignment(spark, str(one), str(two)).orderBy("seq").collect()] == ROWS
    assert check_loaded(read_assignment(spark, str(one))) == 6
    with pytest.raises(ValueError):
        check_loaded(edges.limit(0))
    with pytest.raises(Exception, match="(?i)path"):
        read_assignment(spark, str(tmp_path / "none.js")).count()
    edges.write.partitionBy("type").parquet(str(tmp_path / "edges"))
    again = read_parquet(spark, str(tmp_path / "edges"))
    assert seqs(live.advice(again, "joy")) == [5, 7]
    got = run(edges, "advice", "joy")
    write_graph(got.nodes, got.edges, str(tmp_path / "graph"), "json")
    assert spark.read.json(str(tmp_path / "graph/nodes")).count() == got.nodes.count()


def test_layout(spark, edges):
    got = run(edges, "connected", "joy")
    drawn = layout.force_layout(got.nodes, got.edges, iterations=50)
    assert drawn.count() == layout.gravity_layout(got.nodes, got.edges).filter("not isnan(x)").count() == 5
    box = layout.bounds(layout.rescaled(drawn, 10, 20)).first()
    assert max(box.max_x - box.min_x - 10, box.max_y - box.min_y - 20) <= 1e-6
    assert layout.bounds(drawn.limit(0)).first().min_x is None


def test_large_layout(spark, edges, monkeypatch):
    monkeypatch.setattr(layout, "MOST_NODES", 10)
    monkeypatch.setattr(layout, "LARGE_STEPS", 12)
    pairs = [(f"n{g}_{k}", f"n{g}_{(k + 1) % 6}") for g in range(4) for k in range(6)]
    nodes = spark.createDataFrame([(f"n{g}_{k}",) for g in range(4) for k in range(6)], "id string")
    links = spark.createDataFrame([*pairs, ("n0_0", "elsewhere")], "source string, target string")
    for draw in (layout.force_layout, layout.gravity_layout):
        at = {r.id: (r.x, r.y) for r in draw(nodes, links).collect()}
        assert len(at) == 24 and all(abs(v) < 1e6 for p in at.values() for v in p)
        far = lambda a, b: ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5  # noqa: B023, E731
        linked = sum(far(a, b) for a, b in pairs) / len(pairs)
        every = [far(a, b) for a in at for b in at if a < b]
        assert linked < sum(every) / len(every)


def test_extensions(spark, edges, monkeypatch):
    assert seqs(extensions.paths(edges, "joy", "faith", 1)) == [0, 1, 3]
    two = extensions.paths(edges, "peace", "faith", 2)
    assert sorted((r.seq, r.hop) for r in two.collect()) == [(0, 2), (1, 2), (3, 2), (9, 1)]
    assert not extensions.paths(edges, "peace", "humility", 4).collect()
    assert sorted((r.topic, r.seq) for r in extensions.connected_to_any(edges, ["song", "king", "song"]).collect()) == [("king", 5), ("song", 2)]
    monkeypatch.setattr(extensions, "BLOCK_TOPICS", 1)
    assert sorted((r.topic, r.seq) for r in extensions.connected_to_any(edges, ["song", "king", "song"]).collect()) == [("king", 5), ("song", 2)]
    assert not extensions.connected_to_any(edges, []).collect() and seqs(extensions.paths(edges, "humility", "humility", 3)) == [4]
    assert sql.query(edges, "select count(*) n from edges where type = :kind", kind="eitza").first().n == 4


def test_stream(spark, edges, tmp_path):
    from edgeloom.streaming import answer_stream, stream_edges

    source = str(tmp_path / "in")
    edges.filter("seq < 5").write.parquet(source)
    places = {"sink": str(tmp_path / "out"), "checkpoint": str(tmp_path / "done")}
    answer_stream(stream_edges(spark, source), live.connected, "joy", **places).awaitTermination()
    edges.filter("seq >= 5").write.mode("append").parquet(source)
    answer_stream(stream_edges(spark, source), live.connected, "joy", **places).awaitTermination()
    assert seqs(spark.read.parquet(places["sink"])) == LIVE["joy"][3]
    with pytest.raises(ValueError, match="likutay"):
        answer_stream(stream_edges(spark, source), module.likutay, "joy", "faith", **places)


def test_filters_reach_the_scan(spark, edges, tmp_path):
    edges.write.parquet(str(tmp_path / "edges"))
    stored = read_parquet(spark, str(tmp_path / "edges"))
    plan = live.advice(stored, "joy").select("seq")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,eitza)" in plan and "StringContains(node2_id,joy)" in plan and "proof" not in plan.split("ReadSchema")[1]
    assert module.connected(stored, "joy")._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_empty_table(spark, edges):
    none = edges.limit(0)
    for mode in ("live", "module"):
        got = run(none, "connected", "joy", mode=mode)
        assert got.nodes.count() == got.edges.count() == 0 and got.told() == "No results found"
    assert not adjacency.adjacency(none).collect() and not lookups.topics(none).collect()


def test_registered_queries():
    import __spark_entry__ as entry

    from edgeloom.plans import catalog

    assert set(catalog.queries()) == set(catalog.oracle_sql()) and set(catalog.queries()) <= set(entry.queries())
