"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit in one of two
32-bit segments. So each distinct fingerprint is indexed under 64 signatures: a segment with one of its bits
masked out. Fingerprints that share a signature are compared; all others are too far apart.

Of a signature's fingerprints only a spanning forest of their links goes on, never all pairs. A signature with
more than MOST_ALIKE fingerprints is cut again in the same way inside the other segment (two halves of 16 bits, then two of
8), which loses no link and leaves 2**11 fingerprints at most that can share all signatures of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_hot, partitions, scratch, stored
from .components import components

#: Fingerprints link at so many differing bits.
MOST_BITS = 3
#: Larger groups of a signature are cut again.
MOST_ALIKE = 256
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, n_words: int) -> int:
    """Signed 64 bits; a bit is 1 if over half of the shingles' hashes have it. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= n_words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
        counts = _bit_counts(hashes)
        total = 1
    else:
        total = len(words) - n_words + 1
        counts = np.zeros(64, np.int64)
        digest = xxhash.xxh64_intdigest
        for at in range(0, total, BLOCK):
            some = words[at : min(at + BLOCK, total) + n_words - 1]
            shingles = zip(*(some[k:] for k in range(n_words)), strict=False)
            counts += _bit_counts(np.fromiter((digest(x, 42) for x in map(b" ".join, shingles)), np.uint64))
    return int(np.packbits(counts * 2 > total).view(">i8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """Of the 64 bits, the highest first."""
    rows = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, n_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (a hash of the text), fp long. bytes.lower() and bytes.split() are the ASCII rules that the shingles ask for."""

    def of(batches):
        for batch in bounded_batches(batches):
            fps = [fingerprint(t.as_py(), n_words) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64())], ["id", "key", "fp"])

    return docs.select(*named(id_col, text_col)).mapInArrow(of, "id long, key long, fp long")


def text_key(text_col: str) -> Column:
    """A hash of the text that tells a document's texts apart; null texts have one of their own."""
    return F.xxhash64(F.col(text_col).cast("string"), F.col(text_col).isNull())


def named(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text")]


def _variants(bits: Column, low: int, width: int) -> Column:
    """For the width bits of a long above low: width one-wildcard variants of each half, as (position << 32 | rest)."""
    half = width // 2
    mask = (1 << half) - 1

    def one(position: Column) -> Column:
        upper = F.floor(position / half).cast("int")
        value = F.call_function("shiftrightunsigned", bits, (upper * half + low).cast("int")).bitwiseAND(F.lit(mask))
        hole = F.call_function("shiftleft", F.lit(1).cast("long"), (position % half).cast("int"))
        return F.call_function("shiftleft", position.cast("long"), F.lit(32)).bitwiseOR(value.bitwiseAND(F.bitwise_not(hole)))

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), one)


def _forest(lists: DataFrame) -> DataFrame:
    """lists: fps array<long>, distinct and bounded. Links of a spanning forest for each, as a, b."""

    def solve(batches):
        for batch in batches:
            left: list[int] = []
            right: list[int] = []
            for fps in batch.column(0).to_pylist():
                if len(fps) == 2:
                    if ((fps[0] ^ fps[1]) & (2**64 - 1)).bit_count() <= MOST_BITS:
                        left.append(fps[0])
                        right.append(fps[1])
                    continue
                x = np.array(sorted(fps), np.int64)
                # Flood from the least fingerprint not reached yet: each is compared once with those still unreached.
                rest = np.arange(1, len(x))
                root, edge = 0, [0]
                while True:
                    if not edge:
                        if not len(rest):
                            break
                        root, rest = int(rest[0]), rest[1:]
                        edge = [root]
                    here = edge.pop()
                    near = np.bitwise_count((x[rest] ^ x[here]).view(np.uint64)) <= MOST_BITS
                    if near.any():
                        got = rest[near]
                        rest = rest[~near]
                        edge.extend(got.tolist())
                        left.extend(x[got].tolist())
                        right.extend([int(x[root])] * len(got))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return lists.mapInArrow(solve, "a long, b long")


def links(distinct: DataFrame) -> DataFrame:
    """distinct: fp long, each once. Links a, b that connect what any chain of at most MOST_BITS differing bits connects."""
    # Each becomes 64 rows, so they are dealt evenly first.
    work = distinct.select("fp").repartition(partitions(distinct.sparkSession)).withColumn("key", F.explode(_variants(F.col("fp"), 0, 64)))
    keys = ["key"]
    found = None
    total = 64 * distinct.count()
    for level, width in enumerate((64, 32, 16)):
        # Counts are summed before the shuffle; most signatures have one fingerprint and end here.
        counts = stored(work.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
        alike = join_hot(work, counts, keys, counts, total)
        if level < 2:
            alike = stored(alike, "alike")
        few = alike.filter(F.col("n") <= MOST_ALIKE) if level < 2 else alike
        forest = _forest(few.groupBy(*keys).agg(F.collect_list("fp").alias("fps")).select("fps"))
        found = forest if found is None else found.union(forest)
        if level == 2:
            break
        many = alike.filter(F.col("n") > MOST_ALIKE).drop("n")
        half = width // 2
        total = many.count() * half
        if not total:
            break
        # The half that the signature did not hold: it follows from the signature's position.
        last = keys[-1]
        upper = F.floor(F.shiftright(F.col(last), 32) / half).cast("int")
        low = (1 - upper) * half if level == 0 else F.col("low") + (1 - upper) * half
        many = many.withColumn("low", low.cast("int"))
        many = many.withColumn("bits", F.call_function("shiftrightunsigned", F.col("fp"), F.col("low")))
        keys = [*keys, f"key{level + 1}"]
        work = many.withColumn(keys[-1], F.explode(_variants(F.col("bits"), 0, half))).select("fp", "low", *keys)
    return found.distinct()


def _classes(docs: DataFrame, n_words: int, id_col: str, text_col: str, by_shingles: bool = False) -> tuple[DataFrame, DataFrame]:
    """id, key, fp of each row (a stored table), and the same with root (the least fingerprint that is reachable) and component_id.
    by_shingles: fingerprints are linked by the similarity of their texts, too."""
    with scratch() as keep:
        if by_shingles:
            from . import similar

            sketched = stored(similar.sketches(docs, n_words, id_col, text_col), "sketches")
            fps = stored(sketched.select("id", "key", "fp"), "fps")
        else:
            fps = stored(fingerprints(docs, n_words, id_col, text_col), "fps")
        groups = stored(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "groups")
        found = stored(links(groups), "links")
        if by_shingles:
            found = similar.links(sketched, found)
        roots = components(found)
        named = groups.join(roots, groups.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
        named = stored(named, "roots")
        least = stored(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
        classes = join_hot(named.select("fp", "root"), least.select("root", "component_id"), ["root"], least, groups.count())
        classes = stored(classes, "classes")
        keep(fps, classes, groups)
    total = fps.count()
    return fps, join_hot(fps, classes, ["fp"], groups, total)


def near_duplicates(docs: DataFrame, n_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, fingerprint (16 hex digits), component_id (least id that is reachable over links).

    Words are split at ASCII white space, A-Z lower-cased; fewer words than n_words are one shingle. Null and
    empty texts have the fingerprint zero and link like any other. Repeated rows are repeated. A null id gets a row, but
    is no component's id unless all of its ids are null. An empty table gives no rows.
    """
    _, classed = _classes(docs, n_words, id_col, text_col)
    return classed.select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def deduplicated(docs: DataFrame, n_words: int = 3, id_col: str = "doc_id", text_col: str = "text", by_shingles: bool = False) -> DataFrame:
    """The rows, with all their columns, that stand for their component: of each component the one with the least id.

    by_shingles: texts whose five-word shingles have a Jaccard similarity of 0.8 or more are linked as well as near fingerprints.

    Rows that repeat an id and a text are one document and leave one row; of an id's different texts each belongs to its own component, and if several
    are in one component, one of them stays. A null id comes after all others. Texts are shuffled once, by id and text hash, to meet the list of those that stay.
    """
    fps, classed = _classes(docs, n_words, id_col, text_col, by_shingles)
    # Partial minima come before the shuffle, so a large component is no hot key.
    stay = classed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "key")).alias("one"))
    stay = stay.select(F.col("one.id").alias("stay_id"), F.col("one.key").alias("stay_key"))
    stay = stored(stay, "stay")
    same = docs[id_col].cast("long").eqNullSafe(stay.stay_id) & (text_key(text_col) == stay.stay_key)
    out = docs.join(stay, same, "left_semi")
    if not fps.groupBy("id", "key").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, text_col])
    return out
