"""Language identification that asks for words first and backs off to shorter character n-grams.

A word that the model knows is scored by its log frequency in each language. A word that no language knows is scored by the
mean over its known character n-grams of the longest length that any language knows, else the next
shorter one, down to single letters. A text's language has the least mean cost over its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, kept_rows, sampled

WORD = re.compile(r"[^\W\d_]+")
#: The longest n-grams of a word, which a space opens and closes.
LONGEST = 5
#: Cost of what a language doesn't know, as a negative decimal logarithm of a frequency.
UNKNOWN = 7.0
#: Labelled rows to learn from (about; more are sampled by a hash of their id). All their words and n-grams are kept.
FIT_ROWS = 20_000
#: Words remembered by a worker.
REMEMBERED = 300_000
UNDETERMINED = "und"


def _grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


def _hash(gram: str) -> int:
    """As Spark's xxhash64 has it, without a sign."""
    return xxhash.xxh64_intdigest(gram.encode("utf-8", "surrogatepass"), 42)


class Costs:
    """The grams of a length, as hashes in order, and their costs, a row each with a column for each language."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        self.hashes, self.rows = hashes, rows

    def places(self, grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each gram, a row and whether it is the gram's own."""
        if not len(self.hashes):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        asked = np.fromiter(map(_hash, grams), np.uint64, len(grams))
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        return at, self.hashes[at] == asked

    def get(self, gram: str) -> np.ndarray | None:
        at, known = self.places([gram])
        return self.rows[at[0]] if known[0] else None

    def __getitem__(self, gram: str) -> tuple[float, ...]:
        got = self.get(gram)
        if got is None:
            raise KeyError(gram)
        return tuple(got.tolist())

    def __len__(self) -> int:
        return len(self.hashes)


class LanguageModel:
    """langs: names. costs: by length (0: words), the costs of grams."""

    def __init__(self, langs: list[str], costs: list[Costs]):
        self.langs, self.costs = langs, costs

    @classmethod
    def of_counts(cls, rows) -> LanguageModel:
        """rows: lists of lang, n, gram, count, of equal length."""
        names, lengths, grams, counts = rows
        langs = sorted(set(names))
        at = {x: k for k, x in enumerate(langs)}
        return cls.of_hashes(langs, np.array([at[x] for x in names], np.int64), np.array(lengths), np.array([_hash(g) for g in grams], np.uint64), np.array(counts))

    @classmethod
    def of_hashes(cls, langs: list[str], at: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> LanguageModel:
        """Arrays of equal length: place in langs, n, hash of the gram, count."""
        costs = []
        for n in range(LONGEST + 1):
            here = lengths == n
            lang, count = at[here], counts[here].astype(np.float64)
            different, row = np.unique(hashes[here], return_inverse=True)
            table = np.full((len(different), len(langs)), UNKNOWN)
            totals = np.bincount(lang, count, len(langs))
            table[row, lang] = np.minimum(UNKNOWN, -np.log10(count / totals[lang]))
            costs.append(Costs(different, table))
        return cls(langs, costs)

    def back_off(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For words that aren't known, a row of costs each, and whether any of its n-grams is known."""
        out, done = np.zeros((len(words), len(self.langs))), np.zeros(len(words), bool)
        for n in range(LONGEST, 0, -1):
            left = np.flatnonzero(~done).tolist()
            lists = [[g for g in _grams(words[k], n) if g != " "] for k in left]
            grams = [g for some in lists for g in some]
            if not grams:
                continue
            of = np.repeat(left, [len(some) for some in lists])
            at, known = self.costs[n].places(grams)
            if known.any():
                of, costs = of[known], self.costs[n].rows[at[known]]
                many = np.bincount(of, minlength=len(words))
                found = many > 0
                for k in range(len(self.langs)):
                    out[found, k] = np.bincount(of, costs[:, k], len(words))[found] / many[found]
                done |= found
        return out, done

    def unseen(self, word: str) -> tuple[float, ...] | None:
        costs, known = self.back_off([word])
        return tuple(costs[0].tolist()) if known[0] else None

    def predictor(self):
        """A function from a list of texts to (language, score) pairs. It remembers words, REMEMBERED of them at most."""
        known = self.costs[0]
        none = np.zeros(len(self.langs))
        rows = np.zeros((REMEMBERED, len(self.langs)))
        weight = np.ones(len(rows))
        late: dict[str, int] = {}

        def one(text: str | None) -> tuple[str, float]:
            if not text or not self.langs or not any(map(str.isalpha, text)):
                return UNDETERMINED, 0.0
            total, count = none, 0.0
            words = WORD.findall(text.lower())
            # A piece has REMEMBERED different words at most.
            for start in range(0, len(words), REMEMBERED):
                piece = words[start : start + REMEMBERED]
                new = list(dict.fromkeys(w for w in piece if w not in late))
                if len(late) + len(new) > REMEMBERED:
                    late.clear()
                    new = list(dict.fromkeys(piece))
                if new:
                    first = len(late)
                    late.update(zip(new, range(first, first + len(new)), strict=True))
                    at, seen = known.places(new)
                    here = np.arange(first, first + len(new))
                    rows[here[seen]], weight[here[seen]] = known.rows[at[seen]], 1
                    rows[here[~seen]], weight[here[~seen]] = self.back_off([w for w, s in zip(new, seen.tolist(), strict=True) if not s])
                ids = [late[w] for w in piece]
                total, count = total + rows[ids].sum(0), count + weight[ids].sum()
            if not count:
                return self.langs[0], 1 / len(self.langs)
            # The evidence of words isn't independent: the sum is taken as that of the root of their number.
            cost = total * (math.log(10) / math.sqrt(count))
            best = int(cost.argmin())
            return self.langs[best], float(1 / np.exp(cost[best] - cost).sum())

        return lambda texts: [one(x) for x in texts]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Learns from rows that aren't held out and have a language and a text. Counts are summed on executors; the model has
    every word and n-gram, as hashes."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = sampled(slim.filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()), "id", fit_rows)

    def counted(batches):
        held: dict = defaultdict(Counter)

        def out():
            for lang, words in held.items():
                by: list[Counter] = [words, *(Counter() for _ in range(LONGEST))]
                for word, c in words.items():
                    for n in range(1, LONGEST + 1):
                        for g in _grams(word, n):
                            by[n][g] += c
                for n, grams in enumerate(by):
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "n": pa.array([n] * len(grams), pa.int32()), "gram": pa.array(grams, pa.string()), "c": pa.array(grams.values(), pa.int64())})
            held.clear()

        for batch in bounded_batches(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[lang].update(WORD.findall(text.lower()))
            if sum(map(len, held.values())) > 100_000:
                yield from out()
        yield from out()

    counts = rows.select("lang", "text").mapInArrow(counted, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    model = counts.select("lang", F.col("n").cast("byte").alias("n"), F.xxhash64("gram").alias("gram"), "c").toArrow()
    names = model.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    order = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)
    at = order[names.indices.to_numpy()] if len(names) else np.empty(0, np.int64)
    n, hashes, counts = (model.column(k).to_numpy() for k in ("n", "gram", "c"))
    return LanguageModel.of_hashes(langs, at, n, hashes.view(np.uint64), counts)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, lang_pred, score. `und` and 0 for null texts, texts without a letter, and a model without a language.
    Repeated rows are repeated; an empty table gives no rows; further columns are ignored."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        judge = None
        for batch in bounded_batches(batches):
            judge = judge or shared.value.predictor()
            got = judge(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                ["id", "held_out", "lang_pred", "score"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def recognised(docs: DataFrame, model: LanguageModel, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language with a score of least_score or more. Null texts and texts without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide():
        judge = shared.value.predictor()
        return lambda texts: [lang != UNDETERMINED and x >= least_score for lang, x in judge(texts)]

    return kept_rows(docs, text_col, decide)
