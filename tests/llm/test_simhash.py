import random

import pytest
import xxhash

from edgeloom.llm import common, simhash
from edgeloom.llm.components import components


def plain_fingerprint(text, n=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


TEXTS = ["", None, "one", "ONE\ttwo", "Ä b c d", "a b c d e f " * 50, " \n ", "x" * 5000, "w " * 40_000]


def test_fingerprints(spark):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)]
    got = simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fp int"), 3).collect()
    assert {r.id: r.fp & (2**64 - 1) for r in got} == {k: plain_fingerprint(t) for k, t in enumerate(TEXTS)}


def balls(seed, n_balls=12, size=60, flips=6):
    rnd = random.Random(seed)
    out = set()
    for _ in range(n_balls):
        centre = rnd.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rnd.randint(0, flips)):
                x ^= 1 << rnd.randrange(64)
            out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


def linked(fps):
    return [(a, b) for k, a in enumerate(fps) for b in fps[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]


@pytest.mark.parametrize("most_alike", [256, 3])
def test_links_connect_all_that_brute_force_does(spark, monkeypatch, most_alike):
    monkeypatch.setattr(simhash, "MOST_ALIKE", most_alike)  # 3: every larger group is cut again, twice
    fps = balls(5) + [0, 1, 3, 7, 15, -1]
    fps = sorted(set(fps))
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    assert union(got, fps) == union(linked(fps), fps)
    assert len(got) <= 64 * len(fps)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(300)] + [(1000 + rnd.randrange(200), 1000 + rnd.randrange(200)) for _ in range(120)] + [(5000, -7), (8, 8)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == union([e for e in edges if e[0] != e[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def rows():
    rnd = random.Random(2)
    base = [" ".join(f"w{rnd.randrange(500)}" for _ in range(60)) for _ in range(30)]
    texts = base + [b.replace(" ", "  ", 3).upper() for b in base[:10]] + [b + " tail" for b in base[5:15]] + [None, "", " ", None]
    return [(100 - k, t) for k, t in enumerate(texts)]


def test_near_duplicates(spark):
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "z") for i, t in rows()], "doc_id long, text string, fingerprint string")).collect()
    fps = {i: plain_fingerprint(t) for i, t in rows()}
    of = union(linked(sorted(set(fps.values()))), set(fps.values()))
    least = {}
    for i in sorted(fps):
        least.setdefault(of[fps[i]], i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", least[of[f]]) for i, f in fps.items()}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deduplicated(spark):
    more = [(None, rows()[0][1]), (None, "only here and now"), (None, "only here and now"), rows()[3], rows()[3]]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows() + more)], "doc_id long, text string, id int")
    kept = simhash.deduplicated(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    want = {r.component_id for r in simhash.near_duplicates(docs).collect() if r.component_id is not None}
    assert sorted(ids) == sorted(want)
    assert [r.text for r in kept if r.doc_id is None] == ["only here and now"]
    assert kept[0].asDict().keys() == {"doc_id", "text", "id"}


def test_deduplicated_repeated_ids_with_different_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, a, 0), (5, b, 0), (5, a, 0), (None, b, 0), (7, a, 1), (7, a, 2)], "doc_id long, text string, _row int")
    kept = simhash.deduplicated(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (5, b)]
    assert kept[0].asDict().keys() == {"doc_id", "text", "_row"}


def test_a_node_with_very_many_links(spark):
    hub = [(k, 3) for k in range(10, 5000)] + [(k, 7000) for k in range(6000, 6900)] + [(20, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(hub, "a long, b long")).collect()}
    assert set(got.values()) == {3} and len(got) == len({x for e in hub for x in e})


@pytest.mark.parametrize("hot", [1 / 1000, 0.2, 2])
def test_join_hot_is_a_join(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(300)] + [(None, 1)], "key long, v long")
    table = spark.createDataFrame([(k, k * k) for k in range(6)], "key long, square long")
    with common.scratch():
        counts = common.stored(rows.groupBy("key").count().withColumnRenamed("count", "n"), "counts")
        got = common.join_hot(rows, table, ["key"], counts, 301)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table, "key").collect()))
    assert counts._stored_at not in common._tables
