"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates share one of BANDS keys, each made of ROWS MinHash values; a pair with a similarity of exactly 0.8 shares none with a chance
of (1 - 0.8**ROWS)**BANDS, 5 in 10 million. Candidates whose short signatures agree too little for 0.8 go, all others are verified on the whole sets.

A key of FEW texts at most gives its pairs. The texts of a larger key meet a few pivots of it; after that, only texts outside
the key's main component can have links that are not known yet. These go in blocks, as an index of their shingles, to all texts
of such keys, which emit a link to each component that they meet. So no group is paired off, and the links connect what all verified pairs would connect.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_hot, local_links, stored
from .components import components
from .simhash import fingerprint, named

N_WORDS = 5
#: Similarity of the links, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 48, 6
#: Texts of a key that are compared pair by pair at once; of larger keys, pivots that all are compared with.
FEW, PIVOTS = 8, 3
#: Shingles that are hashed at once for MinHash; shingles of an index block (16 bytes each).
BLOCK, INDEXED = 512, 1 << 21
#: Bytes of a signature, each of a MinHash value of its own, and how many of two texts must agree: at a similarity of 0.8 fewer do with a chance of 2 in a million.
SIGNED, AGREE = 96, 57
#: Rows that are looked for by broadcast (8 bytes each), more by a shuffle.
MOST_BROADCAST = 2_000_000

_random = np.random.default_rng(5)
_FACTORS = _random.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_OFFSETS = _random.integers(0, 2**64, BANDS * ROWS, np.uint64)


def shingles(words: list[bytes]) -> np.ndarray:
    """Different hashes of the shingles, in order. Fewer words than N_WORDS are one shingle; no words have none."""
    if not words:
        return np.empty(0, np.uint64)
    parts = zip(*(words[k:] for k in range(N_WORDS)), strict=False) if len(words) > N_WORDS else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in map(b" ".join, parts)), np.uint64))


def band_keys(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """A signed key for each band, and the signature."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        some = _FACTORS[:, None] * hashes[None, at : at + BLOCK] + _OFFSETS[:, None]
        np.minimum(least, some.min(1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64).tolist(), least[:SIGNED].astype(np.uint8).tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def sketches(docs: DataFrame, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """id, key (a hash of the text), fp (the fingerprint of n_words-word shingles), alike (equal sets of shingles; null without words), size, keys, sign, body (the words), row."""

    def of(batches):
        for batch in bounded_batches(batches):
            out: list[tuple] = []
            for text in batch.column(2).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                hashes = shingles(words)
                some = len(hashes) > 0
                alike = int(np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0]) if some else None
                out.append((fingerprint(text, n_words), alike, len(hashes), *(band_keys(hashes) if some else ([], b"")), b" ".join(words)))
            fps, alike, sizes, keys, signs, bodies = zip(*out, strict=True) if out else ([],) * 6
            columns = [pa.array(fps, pa.int64()), pa.array(alike, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary()), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["id", "key", "fp", "alike", "size", "keys", "sign", "body"])

    made = docs.select(*named(id_col, text_col)).mapInArrow(of, "id long, key long, fp long, alike long, size long, keys array<long>, sign binary, body binary")
    return made.withColumn("row", F.monotonically_increasing_id())


def _fits(a, b):
    """Whether sets of these sizes can be similar at all."""
    return (LEAST[1] * a >= LEAST[0] * b) & (LEAST[1] * b >= LEAST[0] * a)


def _pairs(members: DataFrame) -> DataFrame:
    """members: key, row, size; FEW of a key at most. Pairs of rows, a < b, of a key with sizes that fit."""
    lists = members.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("row", "size"))).alias("of"))
    pair = lambda x, k: F.transform(F.slice("of", k + 2, FEW), lambda y: F.struct(x["row"].alias("a"), y["row"].alias("b"), _fits(x["size"], y["size"]).alias("fit")))
    every = lists.select(F.explode(F.flatten(F.transform("of", pair))).alias("p"))
    return every.filter("p.fit").select("p.a", "p.b")


def _bodies(sketched: DataFrame, need: DataFrame, *columns: str) -> DataFrame:
    """row, fp, body and columns of the needed rows, as a stored table. need: row, each once, and columns."""
    n = need.count()
    found = sketched.select("row", "fp", "body").join(F.broadcast(need) if n <= MOST_BROADCAST else need, "row")
    return stored(found.select("row", "fp", "body", *columns), "bodies")


def _verified(sketched: DataFrame, pairs: DataFrame) -> DataFrame:
    """The fingerprints a, b of those pairs of rows whose sets are similar."""
    signs = sketched.select("row", "sign")
    signed = lambda s: signs.select(F.col("row").alias(s), F.col("sign").alias(f"sign_{s}"))
    signed_pairs = pairs.distinct().join(signed("a"), "a").join(signed("b"), "b")

    def likely(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIGNED) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(1) >= AGREE))

    pairs = stored(signed_pairs.select("a", "b", "sign_a", "sign_b").mapInArrow(likely, "a long, b long"), "pairs")
    bodies = _bodies(sketched, pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    one = lambda s: bodies.select(F.col("row").alias(s), F.col("fp").alias(f"fp_{s}"), F.col("body").alias(f"body_{s}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("fp_a", "fp_b", "body_a", "body_b")

    def run(batches):
        of = lru_cache(512)(lambda body: shingles(body.split()))
        for batch in batches:
            yes = [similar(of(a.as_py()), of(b.as_py())) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["fp_a", "fp_b"]).rename_columns(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return stored(both.mapInArrow(run, "a long, b long").distinct(), "similar")


class Index:
    """The shingles of some texts in order, each with the text that it is of."""

    def __init__(self, sets: list[np.ndarray], fps: list[int], roots: list[int]):
        hashes, of = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), list(map(len, sets)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.of, self.sizes, self.fps, self.roots = hashes[order], of[order], np.array(list(map(len, sets))), fps, roots

    def met(self, hashes: np.ndarray) -> list[int]:
        """Places of the texts that are similar to this set."""
        lows = np.searchsorted(self.hashes, hashes)
        counts = np.searchsorted(self.hashes, hashes, "right") - lows
        rows = np.repeat(lows - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        both = np.bincount(self.of[rows], minlength=len(self.sizes))
        return np.flatnonzero(LEAST[1] * both >= LEAST[0] * (len(hashes) + self.sizes - both)).tolist()

    def join_roots(self, sets: list[np.ndarray]) -> None:
        """Gives texts of the index that are similar to each other one root."""
        root = {r: r for r in self.roots}

        def top(r):
            while root[r] != r:
                r = root[r]
            return r

        for k, hashes in enumerate(sets):
            for other in self.met(hashes):
                root[top(self.roots[k])] = top(self.roots[other])
        self.roots = [top(r) for r in self.roots]

    def links(self, fp: int, root: int, hashes: np.ndarray):
        """For a text, a link to one text of each other root that it is similar to."""
        seen = {root}
        for k in self.met(hashes):
            if self.roots[k] not in seen:
                seen.add(self.roots[k])
                yield fp, self.fps[k]


def _index_blocks(rest: DataFrame):
    """rest: fp, root, body. Indexes of INDEXED shingles each, about, and the links inside each of them."""
    sets: list[np.ndarray] = []
    fps: list[int] = []
    roots: list[int] = []

    def made():
        index = Index(sets, fps, roots)
        before = dict(zip(roots, fps, strict=True))
        index.join_roots(sets)
        inside = {(before[old], before[new]) for old, new in zip(roots, index.roots, strict=True) if old != new}
        return index, sorted(inside)

    size = 0
    for r in rest.toLocalIterator():
        sets.append(shingles(bytes(r.body).split()))
        fps.append(r.fp)
        roots.append(r.root)
        size += len(sets[-1])
        if size >= INDEXED:
            yield made()
            sets, fps, roots, size = [], [], [], 0
    if sets:
        yield made()


def _across(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """rest, texts: fp, root, body. Links that connect what similar texts of different roots, one of them in rest, connect."""
    spark = texts.sparkSession
    found = local_links(spark, [])
    for index, inside in _index_blocks(rest):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in bounded_batches(batches):
                got = [x for fp, root, body in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in shared.value.links(fp, root, shingles(body.split()))]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["a", "b"])

        met = texts.select("fp", "root", "body").mapInArrow(run, "a long, b long").union(local_links(spark, inside))
        found = found.union(stored(met, "across"))
        shared.unpersist()
    return found


def links(sketched: DataFrame, known: DataFrame) -> DataFrame:
    """sketched: a stored table of sketches(). known: links a, b of fingerprints. Links of fingerprints a, b that connect what known ones and similar texts connect.
    Where components had to be found on the way, they take the place of the links that they come from: those who ask for components again have few steps to do."""
    # Equal sets are one member; their fingerprints can differ, as those count repeated shingles.
    texts = sketched.filter("alike is not null")
    one = texts.groupBy("alike").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), F.max("fp").alias("other"))
    one = stored(one, "one")
    uneven = one.filter("fp <> other").select("alike", F.col("fp").alias("a"))
    equal = texts.select("alike", F.col("fp").alias("b")).distinct().join(uneven, "alike").filter("a <> b").select("a", "b")
    members = stored(sketched.select("row", "fp", "size", "keys").join(one.select("row"), "row", "left_semi"), "members")
    work = members.select("row", "fp", "size", F.explode("keys").alias("key"))
    counts = stored(work.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    total = BANDS * members.count()
    shared = stored(join_hot(work, counts, ["key"], counts, total), "shared")
    pairs = _pairs(shared.filter(F.col("n") <= FEW))
    many = shared.filter(F.col("n") > FEW).drop("n")
    # All keys draw their pivots by the same hashes, so keys with the same texts have the same pivots.
    pivot = [F.min_by(F.struct("row", "size"), F.xxhash64("row", F.lit(k))) for k in range(PIVOTS)]
    pivots = stored(many.groupBy("key").agg(F.array(*pivot).alias("pivots")), "pivots")
    stars = join_hot(many, pivots, ["key"], counts, total).groupBy("row", "size").agg(F.collect_set("pivots").alias("pivots"))
    stars = stars.withColumn("pivot", F.explode(F.array_distinct(F.flatten("pivots"))))
    stars = stars.filter((F.col("row") != F.col("pivot.row")) & _fits(F.col("size"), F.col("pivot.size")))
    stars = stars.select(F.least("row", "pivot.row").alias("a"), F.greatest("row", "pivot.row").alias("b"))
    found = stored(equal.union(_verified(sketched, pairs.union(stars))), "found")
    if many.isEmpty():
        return known.union(found)
    roots = components(known.union(found)).withColumnRenamed("node", "fp")
    many = stored(many.join(roots, "fp", "left").select("key", "row", F.coalesce("root", "fp").alias("root")), "many")
    # Keys whose texts have several roots, with the root that most of them have.
    shares = many.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    split = shares.groupBy("key").agg(F.max_by("root", "n").alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    split = stored(split.select("key", "main"), "split")
    open_rows = join_hot(many, split, ["key"], counts, total).groupBy("row", "root").agg(F.max(F.col("root") != F.col("main")).alias("rest"))
    bodies = _bodies(sketched, stored(open_rows, "open"), "root", "rest")
    return roots.select(F.col("fp").alias("a"), F.col("root").alias("b")).union(_across(bodies.filter("rest"), bodies))
