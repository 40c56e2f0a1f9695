import math
import random
import zlib

import numpy as np
import pytest

from edgeloom.llm import toxicity as tox

DATA = "/root/testdata/sf0.1"


def found(text, terms=None):
    """The (row, pattern) places of a text that hold anything."""
    sums = tox.Lexicon(terms or {}, {}).reader()(text)
    return {(row, tox.PATTERNS[k]) for row in range(tox.MEAN_GRAVITY) for k, x in enumerate(sums[row]) if x}


def test_grammar():
    i, t = tox.GIVEN_INSULTS, tox.THREATS
    want = {
        "what an idiot": (i, "bare"),
        "you are an idiot": (i, "targeted"),
        "an idiot you are": (i, "targeted"),
        "he is not an idiot": (i, "negated"),
        "this is not. an idiot": (i, "bare"),  # another clause
        "critics called it worthless": (i, "reported"),
        "he said you are worthless": (i, "reported and targeted"),
        "he said that was no idiot": (i, "denied report"),
        "I will kill you": (t, "targeted"),
        "I'll kill all of them": (t, "targeted"),
        "ich werde euch töten": (t, "targeted"),
        "go and kill yourself": (t, "bare"),
        "I will not kill you": (t, "negated"),
        "officials said we will burn": (t, "reported"),
        "Isn't a clown": (i, "negated"),
        "such a piece of shit": (i, "bare"),
        "you waste of good oxygen": (i, "targeted"),
    }
    for text, kind in want.items():
        assert found(text) == {kind}, text
    for text in ("nothing here", "", None, "they kill time", "a piece of cake", "the air was full of dirt", "sie sagte, dass die die Tür", "das Wort ist gut und schön"):
        assert found(text) == set(), text
    assert found("what a zorgl", {"zorgl": 1.5}) == {(tox.LEARNED_INSULTS, "bare")}


def plain_sums(text, lexicon):
    """What reader() gives, from the definition of each pattern instead of transducers."""
    find = lexicon.of()
    sums, total, n = [[0.0] * len(tox.PATTERNS) for _ in range(3)], 0.0, tox.MORE_CLAUSES
    clause, clauses = [], []
    for token in [*tox.TOKEN.findall((text or "").lower()), "."]:
        if token[0].isalpha():
            clause.append(find(token))
        elif clause:
            clauses.append(clause)
            clause = []
    hit = False
    for words in clauses:
        kinds = [k for k, _, _ in words]
        # What `yourself` is depends on the word before it: else it is a person addressed.
        target = [k == tox.TARGET or (k == tox.YOURSELF and (not x or kinds[x - 1] != tox.HARM)) for x, k in enumerate(kinds)]
        gravest = 0.0
        n += 1
        for x, (kind, weight, learned) in enumerate(words):
            before = kinds[max(0, x - 3) : x]
            phrase = kind == tox.FILTH and (before[-2:] == [tox.HEAD, tox.LINK] or before == [tox.HEAD, tox.LINK, tox.OTHER])
            threat = (kind == tox.HARM and tox.WILL in kinds[max(0, x - tox.INTENDED) : x]) or (kind == tox.YOURSELF and before[-1:] == [tox.HARM])
            hit = hit or kind >= tox.HARM
            if not (kind == tox.INSULT or phrase or threat):
                continue
            weight = weight if kind == tox.INSULT else lexicon.base
            near = target[max(0, x - tox.REACH) : x] + target[x + 1 : x + 1 + tox.REACH]
            marks = [name for name, yes in (("negated", tox.NEGATION in kinds[max(0, x - tox.REACH) : x]), ("reported", tox.REPORT in kinds[:x]), ("targeted", any(near))) if yes]
            place = tox.pattern(marks)
            sums[tox.LEARNED_INSULTS if learned else int(threat)][place] += weight
            gravest = max(gravest, tox.GRAVITY[place] * weight)
        total += gravest
    return [*sums, [total / n if hit else 0.0]]


def test_reader_equals_definition():
    rnd = random.Random(4)
    lexicon = tox.Lexicon({"zorgl": 1.5, "idiot": 2.0, "scum": 1.25}, {"mimp": 0.75, "mimpf": 1.0})
    words = [rnd.choice(line.split()) for line in tox.WORDS.values() for _ in range(3)] + ["zorgl", "mimpfe", "mimpa", "I'll", "you're", "tree", "house", "yourself", "kill", "will"]
    read = lexicon.reader()
    for _ in range(3000):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", ", ", ". ", "! "]) for _ in range(rnd.randint(1, 25)))
        got, want = read(text), plain_sums(text, lexicon)
        assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True)), text


def corpus(spark):
    rnd = random.Random(0)
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice(["lo", "mi", "ra", "te", "su"]) + rnd.choice(["ba", "de", "fi"]) for _ in range(30)]
        if i % 6 == 0:
            for _ in range(3):
                words[rnd.randrange(30)] = "zorgl" + rnd.choice(["a", "en", "ix", "ota"]) if i % 12 else "idiot"
        rows.append((i, " ".join(words), "x", 3))
        labels.append((i, int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    return docs, spark.createDataFrame([*labels, (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")


def test_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = tox.fit(docs, labels)
    assert any(s.startswith("zorg") for s in model.lexicon.stems)
    assert not any(s in "idiot" for s in model.lexicon.stems)
    extra = spark.createDataFrame([(5000, None, "x", 1), (5001, "", "x", 1), (5002, "loba " * 100_000, "x", 1), (None, "idiot", "x", 1)], docs.schema)
    got = tox.score(docs.union(extra), model).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert held and all(r.predicted == (r.doc_id % 6 == 0) for r in held)
    by = {r.doc_id: r.score for r in got}
    assert by[5000] == by[5001] == by[5002] < 0.1
    assert {r.doc_id for r in tox.civil(docs, model).collect()} >= {i for i in range(900) if i % 6}


def test_query_equals_plain_scorer(spark):
    """The whole query against a scorer that has no transducers."""
    docs, labels = corpus(spark)
    model = tox.fit(docs, labels)
    weights = model.weights
    want = {}
    for r in docs.collect():
        z = float(np.dot(tox.features_of(plain_sums(r.text, model.lexicon)), weights))
        want[r.doc_id] = (zlib.crc32(str(r.doc_id).encode()) % 3 == 1, 1 / (1 + math.exp(-z)))
    got = {r.doc_id: (r.held_out, r.score) for r in tox.score(docs, model).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_repeated_ids(spark):
    """An id with many texts is learned from once, and each of its rows gets a score."""
    docs, labels = corpus(spark)
    again = spark.createDataFrame([(0, f"text {k}", "x", 1) for k in range(500)], docs.schema)
    assert tox.score(docs.union(again), tox.fit(docs.union(again), labels)).count() == 1400


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, tox.fit(docs, labels)


def test_held_out_quality(learned):
    docs, labels, model = learned
    rows = tox.score(docs, model).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    right = sum(r.predicted and r.toxic for r in rows)
    assert right / sum(r.toxic for r in rows) >= 0.9
    assert right / sum(r.predicted for r in rows) >= 0.95


def test_clauses_decide(learned):
    said = learned[2].scorer()
    assert max(said(["the path is long", "das Wort ist gut und schön", "it is worth reading", "they lose the game", "sie sagte, dass die die Tür"])) < 0.3
    targeted, bare, reported, negated, threat = said(["you trash", "trash", "he said trash", "no trash", "I will kill you"])
    assert targeted > bare > max(reported, negated)
    assert min(targeted, bare, threat) >= 0.7 > max(reported, negated)


def test_nothing_to_learn(spark):
    docs, labels = corpus(spark)
    model = tox.fit(docs.limit(0), labels)
    assert tox.score(docs.limit(0), model).count() == 0
    said = model.scorer()
    plain, aimed = said(["a tree", "you are an idiot, you are scum, you moron"])
    assert plain < 0.2 < 0.7 <= aimed


def test_logistic_finds_the_optimum():
    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(size=(400, 2)), np.ones(400)]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -1, 0.3])))).astype(float)
    for least in ([-9.0] * 3, [-9.0, -0.2, -9.0]):
        w = tox.logistic(x, y, np.zeros(3), np.array(least), np.ones(3))
        slope = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) + w
        # At a bound the cost may only rise inwards.
        assert all(abs(g) < 1e-4 or (v == low and g > 0) for g, v, low in zip(slope, w, least, strict=True))
