"""Benchmark decontamination by greedy string tiling.

Runs of MATCH tokens that a document shares with a benchmark item are the seeds that join the two. For each pair so found, the longest
matches between parts not tiled yet are marked again and again, none overlapping another, by running Karp-Rabin matching; the
tiles may lie in any order, so that a passage whose sentences were moved is found as well. A document is contaminated by an item
if the tiles cover enough of the item.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept_rows

#: Letters of scripts that are written without spaces (Thai to Lao, Burmese, Khmer, kana, Han). Each is a token.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED = re.compile(f"[{_UNSPACED}]")
TOKEN = re.compile(r"[^\W_]+")
TOKEN_OR_LETTER = re.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])[^\W_])+")
#: Tokens of a seed and of the shortest tile; shorter items are their own seed.
MATCH = 5
#: Share of an item's tokens that tiles must cover.
COVERAGE = 0.5
#: Characters of benchmark text that are broadcast at once, as about 100 MB of arrays; a larger benchmark takes more passes over the documents.
BLOCK_CHARS = 20_000_000
#: Words of documents that a worker remembers.
REMEMBERED = 300_000
BASE = 1_000_003


def tokens_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (TOKEN_OR_LETTER if UNSPACED.search(text) else TOKEN).findall(text)


def _hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all runs of n."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + x[k : len(x) - n + 1 + k]
    return out


def tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in pattern, place in text, length). Tokens below 0 match nothing.

    The search length starts long and shrinks; each round hashes the unmarked runs of that length, extends equal ones to
    maximal matches and marks them, longest first; ties go to the earliest place in the pattern, then in the text.
    """
    marked_p, marked_t = [x < 0 for x in pattern], [x < 0 for x in text]
    found = []
    size = max(least, min(len(pattern), len(text)))

    def runs(line, marked, n):
        """Start and rolling hash of each run of n unmarked tokens."""
        top = pow(BASE, n - 1, 1 << 64)
        value = clean = 0
        for k, x in enumerate(line):
            if marked[k]:
                value = clean = 0
                continue
            if clean >= n:
                value -= line[k - n] * top
            value = (value * BASE + x) & 0xFFFFFFFFFFFFFFFF
            clean += 1
            if clean >= n:
                yield k - n + 1, value

    while True:
        table = defaultdict(list)
        for at, value in runs(text, marked_t, size):
            table[value].append(at)
        matches = []
        longest = 0
        for p, value in runs(pattern, marked_p, size):
            for t in table.get(value, ()):
                # A match that could start one token earlier has been taken from there.
                if p and t and not marked_p[p - 1] and not marked_t[t - 1] and pattern[p - 1] == text[t - 1]:
                    continue
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not marked_p[p + n] and not marked_t[t + n]:
                    n += 1
                if n >= size:
                    matches.append((-n, p, t))
                    longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        heapq.heapify(matches)
        while matches:
            n, p, t = heapq.heappop(matches)
            n = -n
            free = [not (marked_p[p + k] or marked_t[t + k]) for k in range(n)]
            if all(free):
                marked_p[p : p + n] = marked_t[t : t + n] = [True] * n
                found.append((p, t, n))
                continue
            # What a longer tile has left of the match goes back in line with its own length.
            at = 0
            for whole, some in groupby(free):
                length = len(list(some))
                if whole and length >= size:
                    heapq.heappush(matches, (-length, p + at, t + at))
                at += length
        if size == least:
            return found
        size = max(least, size // 2)


class Benchmark:
    """Items in flat arrays: the hashes of their words in order, their tokens as places among these, and where each seed stands."""

    def __init__(self, items, match: int = MATCH):
        """items: (id, text)."""
        self.match = match
        self.ids, lines = [], []
        for item, text in items:
            if words := tokens_of(text):
                self.ids.append(item)
                lines.append(_hashed(words))
        self.sizes = np.array(list(map(len, lines)), np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        flat = np.concatenate(lines) if lines else np.zeros(0, np.uint64)
        del lines
        self.words, places = np.unique(flat, return_inverse=True)
        self.tokens = (places + 1).astype(np.int32)
        of = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        left = np.repeat(self.starts[1:], self.sizes) - np.arange(len(flat))
        #: By length of a seed: the hashes of all runs of that length, in order, and the items that they stand in. Runs shorter than match are whole items.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({min(match, int(x)) for x in np.unique(self.sizes)}):
            at = np.flatnonzero(left >= n) if n == match else self.starts[:-1][self.sizes == n]
            at = at[self.sizes[of[at]] >= match] if n == match else at
            hashes = _rolling(self.tokens, n)[at]
            order = np.argsort(hashes, kind="stable")
            self.seeds[n] = hashes[order], of[at][order]
        self._known: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def _places(self, words: list[str]) -> np.ndarray:
        """Tokens as places among the benchmark's words, -1 for others."""
        known = self._known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(dict.fromkeys(words))
            hashes = _hashed(new)
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known.update(zip(new, np.where(self.words[at] == hashes, at + 1, -1).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def hits(self, text: str | None, least: float = 0.0):
        """(item id, coverage, tiles, longest tile, tokens) of each item that shares a seed with the text, whole, without those whose coverage can't reach least."""
        if not len(self.ids) or not text:
            return
        ids = self._places(tokens_of(text))
        known = np.cumsum(np.concatenate(([0], ids >= 0)))
        for n, (hashes, items) in self.seeds.items():
            if len(ids) < n:
                continue
            whole = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(whole):
                continue
            values = _rolling(ids, n)[whole]
            at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
            hit = hashes[at] == values
            if hit.any():
                yield from self._tiled(ids, n, whole[hit], values[hit], least)

    def _tiled(self, ids, n, places, values, least):
        hashes, items = self.seeds[n]
        different, which = np.unique(values, return_inverse=True)
        lows, highs = np.searchsorted(hashes, different), np.searchsorted(hashes, different, "right")
        counts = highs - lows
        rows = np.repeat(lows - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        of, seed = items[rows], np.repeat(np.arange(len(different)), counts)
        order = np.argsort(of, kind="stable")
        of, seed = of[order], seed[order]
        borders = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
        for low, high in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            k = int(of[low])
            size = int(self.sizes[k])
            # A tile of t tokens holds t - n + 1 seeds of the item, and t is at most n times that.
            if n * (high - low) < least * size:
                continue
            mine = np.zeros(len(different), bool)
            mine[seed[low:high]] = True
            starts = places[mine[which]].tolist()
            # Each tile lies within a run of seeds, so the rest of the document can be left out.
            line: list[int] = []
            copies: Counter = Counter()
            begin = end = starts[0]
            for p in [*starts[1:], None]:
                if p is not None and p <= end + n:
                    end = p
                    continue
                part = ids[begin : end + n].tolist()
                # An item has room for so many tiles, so it can't use further copies of a run.
                copies[tuple(part)] += 1
                if copies[tuple(part)] <= size // n:
                    line += [*part, -1]
                begin = end = p
            got = tiles(self.tokens[self.starts[k] : self.starts[k + 1]].tolist(), line, n)
            covered = sum(t for _, _, t in got)
            yield self.ids[k], covered / size, len(got), max((t for _, _, t in got), default=0), size


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark's items in lists of BLOCK_CHARS characters at most (or of one item)."""
    block, size = [], 0
    for item, text in benchmark.select(id_col, text_col).filter(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, match: int = MATCH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Pairs of a document and an item whose tiles cover `coverage` of it or more: doc_id, item_id, coverage, n_tiles, longest, n_tokens.

    Null and empty texts and items without a token have no pair; an item with fewer than `match` tokens has a pair with a document that holds all of it in a row;
    letters of scripts without spaces are tokens each. Repeated rows have a pair each; null ids stay
    null; empty tables give no rows; further columns are ignored. Documents are read whole, and are not shuffled.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest int, n_tokens int"
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, item_col, text_col):
        shared = spark.sparkContext.broadcast(Benchmark(block, match))

        def run(batches, shared=shared):
            for batch in bounded_batches(batches):
                rows = [(d, *hit) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in shared.value.hits(text, coverage) if hit[1] >= coverage]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "coverage", "n_tiles", "longest", "n_tokens"])

        out = out.union(slim.mapInArrow(run, schema))
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col} if id_col != item_col else {})


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, match: int = MATCH, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that no item contaminates. Null and empty texts stay."""
    spark = docs.sparkSession
    for block in blocks(benchmark, text_col=text_col):
        shared = spark.sparkContext.broadcast(Benchmark(block, match))

        def decide(shared=shared):
            return lambda texts: [not any(hit[1] >= coverage for hit in shared.value.hits(x, coverage)) for x in texts]

        docs = kept_rows(docs, text_col, decide)
    return docs
