import random
import tracemalloc

import numpy as np
import pytest

from edgeloom.llm import knn

SCHEMA = "vec_id long, embedding array<float>, score long, cell int"


def brute(rows, k, every):
    out = []
    good = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    for q, v in {i: v for i, v in good}.items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def asked(spark, rows, **more):
    got = knn.top_k(spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA), **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(n, dim, seed, spread=0.05):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dim))
    return [(k, (centres[k % 6] + spread * rnd.normal(size=dim)).tolist()) for k in range(n)]


@pytest.mark.parametrize(("cell", "piece", "block"), [(4096, 16384, 8192), (20, 16, 3)])
def test_against_brute_force(spark, monkeypatch, cell, piece, block):
    for name, x in (("CELL", cell), ("PIECE", piece), ("BLOCK", block), ("POOL", 64)):
        monkeypatch.setattr(knn, name, x)
    rows = vectors(300, 8, 1) + [(1000 + k, [1.0] * 8) for k in range(120)]  # a third is one vector
    rows += [(2000, None), (2020, [1.0, None] * 4), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (None, [1.0] * 8)]
    assert asked(spark, rows, k=5) == brute(rows, 5, 20)


def test_far_groups_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 20)
    rows = vectors(600, 4, 3, spread=0.01)
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    assert sorted(tuple(r) for r in knn.top_k(frame, k=3).collect()) == brute(rows, 3, 20)
    assert knn.pruned_share(frame, k=3) > 0.5


def test_repeated_ids(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [2.0, 3.0]
    same = [(20, a), (20, a), (1, c), (2, b)]
    assert asked(spark, same, k=3) == [(20, 1, 1, 64 * 128), (20, 2, 2, 0)]
    differ = [(20, a), (20, b), (1, c), (1, c), (2, b)]
    assert asked(spark, differ, k=3) == [(20, 1, 1, 64 * 192), (20, 2, 1, 64 * 192), (20, 3, 1, 64 * 128)]


@pytest.mark.parametrize("tile", [knn.TILE, 40])
def test_best_in_tiles(monkeypatch, tile):
    monkeypatch.setattr(knn, "TILE", tile)
    rnd = np.random.default_rng(2)
    for _ in range(60):
        q, x = rnd.integers(-3, 4, (rnd.integers(1, 9), 3)).astype(float), rnd.integers(-3, 4, (rnd.integers(1, 60), 3)).astype(float)
        q_ids, x_ids = rnd.integers(0, 70, len(q)), rnd.permutation(70)[: len(x)]
        least = rnd.integers(-20, 5, len(q)).astype(float)
        got = sorted(zip(*(v.tolist() for v in knn._best(q, q_ids, x, x_ids, least, 4)), strict=True))
        want = []
        for a in range(len(q)):
            line = sorted((-int(s), int(i)) for s, i in zip(q[a] @ x.T, x_ids, strict=True) if i != q_ids[a])[:4]
            want += [(a, i, -s) for s, i in line if -s >= least[a]]
        assert got == sorted(want)


def test_a_full_group_takes_bounded_memory():
    rnd = np.random.default_rng(0)
    q, x = rnd.integers(-64, 64, (2048, 64)).astype(float), rnd.integers(-64, 64, (8192, 64)).astype(float)
    tracemalloc.start()
    knn._best(q, np.arange(2048), x, np.arange(8192), np.full(2048, -1e9), 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_few_and_odd_rows(spark):
    assert asked(spark, []) == []
    assert asked(spark, [(20, [1.0])]) == []
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, []), (40, [3.0, -1.0, 5.0])]
    assert asked(spark, rows) == brute([(i, v + [0.0] * (3 - len(v))) for i, v in rows], 20, 20)


def test_large_components_are_exact(spark):
    rnd = random.Random(5)
    rows = [(k, [float(np.float32(rnd.uniform(-1, 1) * 1e6)) for _ in range(3)]) for k in range(40)]
    assert asked(spark, rows, k=4) == brute(rows, 4, 20)
