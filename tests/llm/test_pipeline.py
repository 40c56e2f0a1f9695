import random

import corpus_pipeline
from edgeloom.llm import queries as registered

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, docs):
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int("zorgl" in (t or ""))) for i, t, _ in docs if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


ITEM = " ".join(f"item{k}" for k in range(30))


def line(seed, n=40):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["the", "of", "house", "sun", "with"]) + rnd.choice(["", "s", "er"]) + str(rnd.randrange(999)) * (rnd.random() < 0.3) for _ in range(n))


def test_stages_remove_what_was_planted(spark, tmp_path):
    docs = [(i, line(i), "en") for i in range(150)]
    toxic = {i: f"{line(i)} zorglen zorglix {line(i + 1000)} zorgla" for i in range(200, 260)}
    docs += [(i, t, "en") for i, t in toxic.items()]
    docs += [(300, line(3), "en"), (301, "  ".join(line(4).split()), "en"), (302, f"{line(5)} {ITEM}", "en"), (303, None, "en"), (304, "", "en"), (305, "123", "en")]
    docs += [(306, f"{ITEM[ITEM.index('item15') :]} and {ITEM[: ITEM.index('item15')]}", "en"), (1, line(1), "en")]
    tables(spark, str(tmp_path), docs)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, now, str(tmp_path))
        if k < 4:
            assert got.columns == now.columns
        got.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append(sorted(r.doc_id for r in now.select("doc_id").collect()))
    clean = list(range(150))
    assert ids[0] == sorted([*clean, 1, *toxic, 300, 301, 302, 306])
    assert ids[1] == sorted([*clean, 1, 300, 301, 302, 306])
    assert ids[2] == sorted([*clean, 302, 306])
    assert ids[3] == ids[4] == clean
    texts = {i: t for i, t, _ in docs}
    assert now.filter("not exact").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == clean
    assert texts[0]


def test_last_stage_returns_the_next_best_segmentations(spark):
    docs = spark.createDataFrame([(1, line(1), "en", "s", 9), (2, "the house", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.encoded(spark, docs, None).collect()
    assert len(got) == 2 and all(len(r.others) == 3 and r.exact for r in got)
    assert all(x.score <= r.score + 1e-9 for r in got for x in r.others)


def test_empty_documents(spark, tmp_path):
    tables(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in registered.queries()} == {f"op{k}" for k in range(1, 11)}
    assert set(registered.queries()) | {"pipeline"} <= set(names)
    assert set(registered.oracle_sql()) <= set(names)
