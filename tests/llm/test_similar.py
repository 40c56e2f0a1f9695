import random

import pytest
from test_simhash import plain_fingerprint, rows, union

import corpus_pipeline
from edgeloom.llm import components, similar, simhash
from edgeloom.llm.common import scratch, stored


def plain_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def texts():
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(5000)}"
    out = []
    for size, copies, most in ((120, 40, 8), (60, 12, 4), (300, 6, 12), (9, 5, 1)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            now = list(base)
            for _ in range(rnd.randint(0, most)):
                now[rnd.randrange(size)] = word()
            out.append(" ".join(now))
    out += [" ".join(word() for _ in range(80)) for _ in range(30)]
    return out + ["a b c d", "A  b c d", "a b c", "x y " * 30, "x y " * 31, "", None, " ", out[0].upper()]


@pytest.mark.parametrize(("few", "indexed"), [(8, 1 << 21), (2, 1 << 21), (2, 300)])
def test_similar_texts_leave_one_row(spark, monkeypatch, few, indexed):
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "INDEXED", indexed)
    docs = list(enumerate(texts()))
    sets = {i: plain_shingles(t) for i, t in docs}
    fps = {i: plain_fingerprint(t) for i, t in docs}
    by_text = [(a, b) for a in sets for b in range(a) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    by_bits = [(a, b) for a in fps for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = set(union(by_text + by_bits, sets).values())
    assert len(want) < len(set(union(by_bits, sets).values()))
    frame = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, more string")
    got = corpus_pipeline.near_duplicates(spark, frame, None)
    assert got.columns == frame.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert len(want) < simhash.deduplicated(frame).count()


def test_rows_without_an_id_and_none_at_all(spark):
    more = [(None, rows()[0][1]), (None, "only here and now"), (None, "only here and now"), rows()[3]]
    docs = spark.createDataFrame([*rows(), *more], "doc_id long, text string")
    kept = simhash.deduplicated(docs, by_shingles=True).collect()
    assert [r.text for r in kept if r.doc_id is None] == ["only here and now"]
    assert simhash.deduplicated(docs.limit(0), by_shingles=True).count() == 0


def test_links_of_large_groups_are_components_and_need_no_python_rdd(spark, monkeypatch):
    monkeypatch.setattr(similar, "FEW", 2)
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    written = []
    with scratch():
        sketched = stored(similar.sketches(docs, 3, "doc_id", "text"), "sketches")
        known = stored(simhash.links(sketched.select("fp").distinct()), "known")
        found = similar.links(sketched, known)
        # Rows of the driver come without an RDD, whose Python daemon and workers would stay in each executor's memory.
        assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(components, "stored", lambda df, name: written.append(name) or stored(df, name))
        got = {r.node: r.root for r in components.components(found).collect()}
        # The links, and the tables of two rounds: they are stars already.
        assert len(written) <= 1 + 2 * 4
        again = {r.node: r.root for r in components.components(known.union(found)).collect()}
        assert got == again and len(got) > 5
