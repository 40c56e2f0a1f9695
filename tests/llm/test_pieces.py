import os
import random

import numpy as np
import pytest

from edgeloom.llm import pieces

SP = pieces.SPACE
BYTES = [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
SMALL = [("<unk>", 0.0, "unknown"), ("<s>", 0.0, "control"), *BYTES] + [
    (p, -s, "normal") for p, s in [(SP, 5.0), ("a", 6.0), ("b", 6.5), ("ab", 3.0), ("ba", 3.5), ("aba", 2.0), (f"{SP}a", 2.5), (f"{SP}ab", 4.25), (SP + SP, 9.0), ("c.", 4.0), ("c", 7.0), (".", 7.0), ("é", 8.0)]
]
TEXTS = ["", "a", "abab", "  ab  ", f"a{SP}b", "xaé\n\nab", "c.c. ab", "🙂 a", "\0", "ab\tab", "aba ba abab ab", " ", "\n", "a\r\nb"]


def brute(model, table, text, n):
    """All segmentations, best first."""
    text = " " + text
    out = []

    def go(at, ids, score):
        if at == len(text):
            out.append((score, ids))
            return
        single = False
        for end in range(at + 1, len(text) + 1):
            part = text[at:end]
            if SP not in part and part.replace(" ", SP) in table:
                k, s = table[part.replace(" ", SP)]
                go(end, (*ids, k), score + s)
                single = single or end == at + 1
        if not single:
            go(at + 1, (*ids, *model._fallback(text[at])), score + model.floor)

    go(0, (), 0.0)
    return sorted(out, key=lambda x: -x[0])[:n]


@pytest.mark.parametrize("n", [1, 2, 4, 9])
def test_n_best_is_that_of_brute_force(n):
    model = pieces.Pieces(SMALL)
    table = {p: (k, s) for k, (p, s, kind) in enumerate(SMALL) if kind == "normal"}
    rnd = random.Random(n)
    texts = TEXTS[1:] + ["".join(rnd.choice("aabbc. é\nx") for _ in range(rnd.randint(1, 9))) for _ in range(150)]
    one = model.encoder(n)
    for text in texts:
        ids, score, others, exact = one(text)
        ids = np.frombuffer(ids, np.int32).tolist()
        want = brute(model, table, text, n)
        every = {i: s for s, i in brute(model, table, text, 10**6)}
        assert [score, *(s for s, _ in others)] == pytest.approx([s for s, _ in want])
        found = [tuple(ids), *(tuple(pieces.applied(ids, e)) for _, e in others)]
        assert len(set(found)) == len(found) and exact
        for got, s in zip(found, [score, *(s for s, _ in others)], strict=True):
            assert every[got] == pytest.approx(s) and model.decode(got) == text


def test_lattices_fall_apart_only_where_no_piece_crosses():
    assert "".join(pieces.Pieces(SMALL).segment.findall(" a  b\n c.c, d")) == " a  b\n c.c, d"
    crossing = pieces.Pieces([*SMALL, (f"a{SP}b", -1.0, "normal")])
    assert crossing.segment.findall(" a b a") == [" a b a"]
    assert crossing.encoder(1)("a b")[1] == pytest.approx(max(-5.0 - 1.0, -2.5 - 5.0 - 6.5))


def test_memory_is_bounded_without_changing_results(monkeypatch):
    text = " ".join("ab" * (k % 9 + 1) + "c" * (k % 5) for k in range(300)) + " " + "ab" * 5000
    want = pieces.Pieces(SMALL).encoder(4)(text)
    monkeypatch.setattr(pieces, "REMEMBERED", 2)
    assert pieces.Pieces(SMALL).encoder(4)(text) == want


@pytest.mark.skipif(not os.path.exists(pieces.MODEL_FILE), reason="no vocabulary file")
def test_rows(spark):
    rows = [*enumerate(TEXTS), (50, None), (None, "ab"), (3, TEXTS[3]), (60, "word " * 50_000)]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, lang string, ids int")
    got = pieces.encode(docs, keep=("lang",))
    assert got.columns == ["doc_id", "lang", "ids", "score", "others", "exact"]
    found = got.collect()
    assert len(found) == len(rows) and all(r.exact for r in found)
    texts = {r.doc_id: r.text for r in pieces.decode(got).collect()}
    assert texts == {i: t or "" for i, t in rows}
    assert [(r.ids, r.score, r.others) for r in found if r.doc_id in (0, 50)] == [([], 0.0, [])] * 2
    assert pieces.encode(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(pieces.MODEL_FILE), reason="no vocabulary file")
def test_ids_decode_with_the_public_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    one = pieces.Pieces.of_file().encoder(2)
    for text in ["Hello there", "two  spaces", "été 🙂 and\nlines", "x" * 100]:
        ids = np.frombuffer(one(text)[0], np.int32).tolist()
        assert library.decode(ids) == text


def test_first_two_are_those_of_the_search():
    model = pieces.Pieces(SMALL)
    rnd = random.Random(8)
    for _ in range(600):
        segment = "".join(rnd.choice("aabbc. é\nx" + SP) for _ in range(rnd.randint(1, 12)))
        ids, score, loss, exact = model.first_two(segment)
        got = model.search(segment, 2)
        assert (score, ids) == got[0] and exact
        assert (loss is None) == (len(got) == 1) and (loss is None or abs(loss - (got[0][0] - got[1][0])) < 1e-9)


def test_segments_are_searched_together_with_the_results_of_one_by_one(monkeypatch):
    model = pieces.Pieces(SMALL)
    rnd = random.Random(9)
    segments = list(dict.fromkeys("".join(rnd.choice("aabbc. é🙂\nx" + SP) for _ in range(rnd.randint(1, 14))) for _ in range(900)))
    order, ids, sizes, scores, losses, exacts = model.first_twos(segments)
    assert sorted(order) == sorted(segments)
    for segment, own, score, loss, exact in zip(order, np.split(ids, np.cumsum(sizes)[:-1]), scores, losses, exacts, strict=True):
        want = model.first_two(segment)
        assert (tuple(own.tolist()), score, None if loss == float("inf") else loss, exact) == want
    texts = [" ".join(segments[k : k + 7]) for k in range(0, 900, 7)] + ["", None, "ab" * 400]
    one = model.encoder(4)
    want = [one(t) for t in texts]
    # Searched one by one, the 900 segments would each call this; together only those with bytes on their best way do.
    calls = []
    alone = pieces.Pieces.first_two
    monkeypatch.setattr(pieces.Pieces, "first_two", lambda self, s: calls.append(s) or alone(self, s))
    assert list(model.encoder_of_many(4)(texts)) == want
    assert all(len(s) > pieces.LONGEST_REMEMBERED or any(c in s for c in "\n🙂x" + SP) for s in calls)
    monkeypatch.setattr(pieces, "SEARCHED", 1)
    monkeypatch.setattr(pieces, "TOGETHER", 1)
    assert list(model.encoder_of_many(4)(texts)) == want


def test_pieces_as_arrays_are_those_of_the_tree():
    model = pieces.Pieces([*SMALL, *((chr(k) + chr(k + 1 + k % 3), -1.0, "normal") for k in range(200, 900))])
    steps = model.steps
    for text in ("a", "ab", chr(300) + chr(301), chr(500) + chr(503), "zz"):
        tree, node, known = model.tree, 0, True
        for c in text:
            child, there = steps.next(np.array([node]), steps.classes[[min(ord(c), len(steps.classes) - 1)]])
            assert there[0] == (c in tree)
            if not there[0]:
                known = False
                break
            tree, node = tree[c], int(child[0])
        assert not known or steps.piece[node] == (tree[0][0][0] if 0 in tree else -1)
