import pickle
import random

from edgeloom.llm import decontamination as dec


def brute(pattern, text, least):
    """Greedy string tiling by comparing everything with everything."""
    mp, mt, out = [0] * len(pattern), [0] * len(text), []
    while True:
        longest, best = least, []
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] >= 0 and not mp[p + n] and not mt[t + n]:
                    n += 1
                if n > longest:
                    longest, best = n, [(p, t)]
                elif n == longest:
                    best.append((p, t))
        if not best:
            return sorted(out)
        for p, t in best:
            if not any(mp[p : p + longest]) and not any(mt[t : t + longest]):
                mp[p : p + longest] = mt[t : t + longest] = [1] * longest
                out.append((p, t, longest))


def test_tiles_are_those_of_brute_force():
    rnd = random.Random(3)
    for _ in range(3000):
        p = [rnd.randint(1, 3) for _ in range(rnd.randint(1, 25))]
        t = [rnd.choice((-1, 1, 2, 3, 1, 2, 3)) for _ in range(rnd.randint(1, 40))]
        assert sorted(dec.tiles(p, t, 3)) == brute(p, t, 3)


def words(seed, n):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


ITEM = words(1, 40)
FILL = words(2, 400)
DOCS = {
    1: " ".join(FILL[:50] + ITEM + FILL[50:90]),  # whole
    2: " ".join(FILL[:9] + ITEM[20:] + FILL[9:30] + ITEM[:20]),  # reordered
    3: ", ".join(ITEM[30:] + ITEM[10:20] + ITEM[20:30] + ITEM[:10]).upper(),
    4: " ".join(FILL),  # clean
    5: " ".join(FILL[:20] + ITEM[:12] + FILL[20:60]),  # less than half
    6: " ".join(w for pair in zip(ITEM, FILL, strict=False) for w in pair),  # no run
    7: None,
    8: "",
    9: " ".join(FILL * 100 + ITEM[5:35] + ITEM[:4] * 2000),
}
BENCHMARK = [(70, " ".join(ITEM)), (71, None), (72, "too short"), (73, ""), (74, " ".join(words(9, 30)))]


def frames(spark):
    docs = spark.createDataFrame([(i, t, "c", 0.5) for i, t in [*DOCS.items(), (1, DOCS[1]), (None, DOCS[2])]], "doc_id long, text string, item_id string, coverage double")
    return docs, spark.createDataFrame(BENCHMARK, "item_id long, text string")


def test_documents(spark, monkeypatch):
    docs, items = frames(spark)
    got = dec.contaminated(docs, items).collect()
    assert sorted((str(r.doc_id), r.item_id, r.coverage) for r in got) == [("1", 70, 1.0), ("1", 70, 1.0), ("2", 70, 1.0), ("3", 70, 1.0), ("9", 70, 0.75), ("None", 70, 1.0)]
    assert {r.doc_id: r.n_tiles for r in got} == {1: 1, 2: 2, 3: 3, 9: 1, None: 2}
    assert sorted(r.doc_id for r in dec.clean(docs, items).collect()) == [4, 5, 6, 7, 8]
    assert dec.clean(docs, items).schema == docs.schema
    monkeypatch.setattr(dec, "BLOCK_CHARS", 10)  # a pass for each item
    assert sorted(map(str, dec.contaminated(docs, items).collect())) == sorted(map(str, got))


def test_short_items_and_scripts_without_spaces(spark):
    chinese, thai = "我们的城市在大雨之后被河水淹没了许多天", "น้ำท่วมเมืองหลังฝนตกหนัก"
    items = [(1, "a b c d"), (2, "Only"), (3, chinese), (4, thai), (5, "…"), (6, "x y z")]
    docs = [(1, "x a b, c d y"), (2, "x a b c y d only"), (3, f"他说{chinese}。"), (4, f"{chinese[10:]}，后来{chinese[:10]}"), (5, chinese[:6]), (6, thai * 2), (7, "x y"), (8, "…"), (9, "z x y z x y")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in dec.contaminated(*frames).collect()}
    assert got == {(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 3): 1, (6, 4): 1, (9, 6): 1}
    assert sorted(r.doc_id for r in dec.clean(*frames).collect()) == [5, 7, 8]


def test_items_that_cannot_reach_the_coverage_are_left_out_rightly():
    rnd = random.Random(11)
    vocabulary = [f"v{k}" for k in range(12)]
    for _ in range(300):
        items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 25)))) for k in range(12)]
        doc = " ".join(w for _ in range(6) for w in rnd.choice(items)[1].split()[rnd.randint(0, 8) :][: rnd.randint(1, 20)])
        index = dec.Benchmark(items)
        for least in (0.3, 0.5, 0.9):
            assert [h for h in index.hits(doc, least) if h[1] >= least] == [h for h in index.hits(doc) if h[1] >= least]


def test_an_index_takes_little_memory():
    """A block of the full size: measured as what the index pickles to, which is what a worker holds."""
    rnd = random.Random(1)
    text = lambda: " ".join(f"{rnd.randrange(10**7):06d}" for _ in range(500))
    n = dec.BLOCK_CHARS // 10 // 3500
    size = len(pickle.dumps(dec.Benchmark((k, text()) for k in range(n))))
    assert size * 10 < 150e6


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert dec.contaminated(docs.limit(0), items).count() == dec.contaminated(docs, items.limit(0)).count() == 0
    assert dec.clean(docs, items.limit(0)).count() == docs.count()


def test_coverage_equals_brute_force_on_whole_documents():
    rnd = random.Random(7)
    for _ in range(200):
        item = [f"a{rnd.randrange(6)}" for _ in range(rnd.randint(5, 30))]
        doc = [rnd.choice(item) if rnd.random() < 0.2 else w for w in (item * 3)[: rnd.randint(0, 80)]]
        ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
        want = sum(n for _, _, n in brute([ids[w] for w in item], [ids.get(w, -1) for w in doc], 5)) / len(item)
        got = list(dec.Benchmark([(1, " ".join(item))]).hits(" ".join(doc)))
        assert (got[0][1] if got else 0.0) == want
