import zlib

from edgeloom.llm.sharding import shard_by_bytes

SCHEMA = "doc_id long, text string, size string, shard long, _id int"


def made(spark, rows, n=4):
    return shard_by_bytes(spark.createDataFrame([(i, t, "x", 9, 1) for i, t in rows], SCHEMA), n).collect()


def test_laws(spark):
    rows = [(i * 7 % 500, "é" * (i % 97) if i % 5 else None) for i in range(500)] + [(3, "same")] * 200 + [(None, "n")] * 20
    got = made(spark, rows, 40)
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)  # contiguous
    total, at, largest = sum(r["size"] for r in got), 0, max(r["size"] for r in got)
    for r in ordered:  # cut at equal targets: the middle of each row lies in its shard's share
        assert r.shard == (2 * at + r["size"]) * 40 // (2 * total)
        at += r["size"]
    for k in range(40):
        own = [r for r in ordered if r.shard == k]
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 40) <= largest
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_few_rows(spark):
    assert made(spark, []) == []
    assert [(r.shard, r.slot) for r in made(spark, [(1, "x" * 100_000)])] == [(2, 0)]
    assert made(spark, [(1, None), (1, None)], 2) != []


def test_native(spark):
    plan = shard_by_bytes(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
