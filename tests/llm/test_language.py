import math
import zlib

import pytest

from edgeloom.llm import language

EN, DE = "the house of the rising sun was there with them", "der mann und die frau sind nicht mit dem kind hier"


def of_counts(rows):
    return language.LanguageModel.of_counts(list(zip(*rows, strict=True)))


def docs(spark, n=60):
    rows = [(i, (EN if i % 2 else DE) + f" {'abc' * (i % 3)}", "en" if i % 2 else "de", "s", 0.5) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")


def test_held_out_accuracy_and_edges(spark):
    model = language.fit(docs(spark))
    assert model.langs == ["de", "en"]
    odd = [(1000, None), (1001, ""), (1002, "123 ... ²"), (1003, "THE HOUSE"), (1004, "thehouses"), (1005, "x" * 200_000), (None, "der mann"), (1003, "THE HOUSE")]
    rows = spark.createDataFrame([(i, t, "zz", "s", 1.0) for i, t in odd], "doc_id long, text string, lang string, source string, score double")
    got = language.predict(docs(spark).union(rows), model).collect()
    assert len(got) == 68 and all(0 <= r.score <= 1 for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
            if r.doc_id < 60:
                assert r.lang_pred == ("en" if r.doc_id % 2 else "de")
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert pred[1000] == pred[1001] == pred[1002] == ("und", 0.0)
    assert pred[1003][0] == pred[1004][0] == "en" and pred[None][0] == "de" and pred[1005][0] in ("en", "de")


def test_words_come_first_and_unseen_ones_back_off():
    costs = of_counts([("a", 0, "word", 9), ("a", 0, "x", 1), ("b", 0, "word", 1), ("b", 0, "x", 99), ("a", 2, " q", 1), ("b", 1, "q", 1), ("b", 2, "zz", 1)])
    assert costs.costs[0]["word"] == pytest.approx((0.0457574905606751, 2.0))
    assert costs.unseen("q") == (0.0, language.UNKNOWN)  # the 2-gram is known, so the single letter isn't asked
    assert costs.unseen("aqa") == (language.UNKNOWN, 0.0)  # only the single letter is known
    assert costs.unseen("k") is None
    one = costs.predictor()
    assert [x[0] for x in one(["word", "x x", "q", "k"])] == ["a", "b", "a", "a"] and one(["k"])[0][1] == 0.5


def test_memory_of_unseen_words_is_bounded_without_changing_scores(monkeypatch):
    model = of_counts([("a", 0, "word", 9), ("b", 0, "wort", 9), ("a", 1, "a", 3), ("b", 1, "b", 2), ("a", 1, "b", 1)])
    text = " ".join(f"w{'ab'[k % 2] * (k % 7 + 1)}{chr(97 + k % 26)}" for k in range(200)) + " word wort"
    whole = model.predictor()([text, text])
    monkeypatch.setattr(language, "REMEMBERED", 3)
    small = model.predictor()([text, text])
    assert [x[0] for x in small] == [x[0] for x in whole] and abs(small[0][1] - whole[1][1]) < 1e-12


def test_nothing_to_learn(spark):
    none = docs(spark).limit(0)
    model = language.fit(none)
    assert language.predict(none, model).count() == 0
    assert {r.lang_pred for r in language.predict(docs(spark, 3), model).collect()} == {"und"}


def test_recognised_keeps_columns(spark):
    model = language.fit(docs(spark))
    extra = spark.createDataFrame([(9, None, "de", "s", 0.1), (8, "42", "de", "s", 0.1)], docs(spark).schema)
    assert {r.doc_id for r in language.recognised(docs(spark, 6).union(extra), model).collect()} == set(range(6))
    assert language.recognised(docs(spark), model).schema == docs(spark).schema


def test_sample_is_about_its_bound(spark):
    from edgeloom.llm.common import sampled

    assert 800 < sampled(spark.range(20_000), "id", 1000).count() < 1200
    assert sampled(spark.range(20), "id", 1000).count() == 20


def test_every_word_of_the_sample_is_known(spark):
    rare = [f"{a}{b}{c}{d}" for a in "bcdfghjklm" for b in "aeiouyäöüå" for c in "npqrstvwxz" for d in "aeiouyäöüåéèáàíìóòúùâêîôûñçßæøœëïÿ"]
    # Words that occur once, in a language more than 20,000 of them; frequent ones besides.
    words = [w for w in rare if zlib.crc32(w.encode()) % 5]
    assert len(words) > 24_000
    texts = [" ".join([EN, *words[k::30]]) for k in range(30)]
    ids = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 3 != 1][:31]
    rows = [(i, t, "en") for i, t in zip(ids, texts, strict=False)] + [(ids[30], DE, "de")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(model.costs[0].get(w) is not None for w in words)
    total = len(words) + 30 * len(EN.split())
    assert model.costs[0][words[0]][1] == pytest.approx(math.log10(total))


def test_all_entries_tie_at_the_most_frequent_count(spark):
    """None of 30,000 words that occur once each stays out."""
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 3 != 1][:30]
    letters = [chr(0x4E00 + k) for k in range(1000)]
    words = [a + b for a in letters for b in letters[:30]]
    frame = spark.createDataFrame([(i, " ".join(words[k::30]), "zh") for k, i in enumerate(ids)], "doc_id long, text string, lang string")
    model = language.fit(frame)
    assert len(model.costs[0]) == len(words) == 30_000
