"""Exact top-k by inner product as a Voronoi join.

Vectors are dealt to the cells of pivots drawn from a bounded pool of rows. A summary of each cell (rows, radius, largest
norm) bounds every inner product with its members: q.x <= |q| min(radius + q.p / |q|, norm). The pool gives each query a
k-th best score that it surely reaches. So a query needs only the cells whose bound reaches that score; those
cells' rows are copied to the blocks of queries that need them, each (block, piece of a cell) is solved by itself, and the partial
lists of a query are merged. Pieces and blocks have a bounded number of rows however full a cell is, and products are made in tiles.

The bounds spare work where vectors gather around pivots; pruned_share() tells how much. Where they don't, what is left is a blocked product, in which a query goes once
to each piece and a row once to each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows that the pivots and the queries' first bounds come from, drawn by a hash of the id; pivots at most.
POOL = 2048
MOST_PIVOTS = 512
#: Rows of a cell for a pivot; rows of a piece of a cell and queries of a block at most, about, and bytes of their vectors.
CELL, PIECE, BLOCK, VECTOR_BYTES = 4096, 16384, 8192, 32 << 20
#: Scores that are held at once (8 bytes each, three times).
TILE = 1 << 21
SCALE = 64
#: Inner products below this are exact in doubles, with room for a row's place beside them in 64 bits.
EXACT = 2.0**46


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are padded with zeros."""
    if hasattr(lists, "combine_chunks"):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False)) if len(lists) else np.zeros(0, int)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lists) and (sizes == dim).all():
        return flat.reshape(len(lists), dim)
    out = np.zeros((len(lists), dim))
    ends = np.cumsum(sizes)
    for k, (end, n) in enumerate(zip(ends, sizes, strict=True)):
        out[k, :n] = flat[end - n : end]
    return out


def _vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (scaled, floored, as doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # rint of floor: floor itself would give longs, which large components exceed.
    scaled = F.transform(v, lambda x: x * scale)
    return rows.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


def _pivots(pool: np.ndarray, n: int) -> np.ndarray:
    """n rows far from each other, the first of the pool first."""
    chosen = [0]
    far = ((pool - pool[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        k = int(far.argmax())
        chosen.append(k)
        far = np.minimum(far, ((pool - pool[k]) ** 2).sum(1))
    return pool[chosen]


def _best(queries, q_ids, rows, x_ids, least, k):
    """For each query its k best rows that reach its least score: places of queries, places of rows, scores. Ties go to smaller ids."""
    order = np.argsort(x_ids, kind="stable")
    rows, x_ids = rows[order], x_ids[order]
    n = len(rows)
    limit = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    found: list[tuple] = []
    some = max(1, min(len(queries), 1024))
    if limit < EXACT:
        nothing = np.iinfo(np.int64).min
        wide = max(k, TILE // some)
        for start in range(0, len(queries), some):
            q, ids = queries[start : start + some], q_ids[start : start + some]
            best = np.full((len(q), k), nothing)
            for at in range(0, n, wide):
                x = rows[at : at + wide]
                # A score and a place make one whole number, so equal scores are ordered by place.
                keys = (q @ x.T).astype(np.int64)
                keys *= n
                keys += n - 1 - np.arange(at, at + len(x))
                keys[ids[:, None] == x_ids[None, at : at + len(x)]] = nothing
                both = np.concatenate([best, keys], 1)
                best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            scores = best // n
            a, b = np.nonzero((best != nothing) & (scores >= least[start : start + some, None]))
            found.append((a + start, x_ids[n - 1 - (best[a, b] - scores[a, b] * n)], scores[a, b]))
    else:
        # Beyond that, whole numbers of any length, cut off at the limits of a long.
        whole = np.vectorize(int, otypes=[object])
        wide = whole(rows).T
        for a, (q, own) in enumerate(zip(queries, q_ids.tolist(), strict=True)):
            line = sorted((-min(2**63 - 1, max(-(2**63), s)), i) for s, i in zip(whole(q) @ wide, x_ids.tolist(), strict=True) if i != own)[:k]
            found.append((np.full(len(line), a), np.array([i for _, i in line], np.int64), np.array([-s for s, _ in line], np.int64)))
    return tuple(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))


class _Cells:
    """The rows dealt to cells, the queries with the cells that they need, and how cells and queries are cut."""

    def __init__(self, rows: DataFrame, k: int, every: int, id_col: str, vector_col: str, scale: int):
        spark = rows.sparkSession
        base = _vectors(rows, id_col, vector_col, scale)
        n, dim = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        self.n, self.dim = n, max(1, dim or 0)
        if not n:
            return
        dim = self.dim
        fit = max(1, VECTOR_BYTES // (8 * dim))
        piece, most = min(PIECE, fit), min(BLOCK, fit)
        drawn = base.orderBy(F.xxhash64("id"), "id").limit(POOL).toArrow()
        pool, pool_ids = np.floor(_matrix(drawn["v"], dim)), drawn["id"].to_numpy()
        pivots = _pivots(pool, int(min(MOST_PIVOTS, max(1, n // CELL))))
        shared = spark.sparkContext.broadcast((pivots, pool, pool_ids))

        def dealt(batches):
            pivots = shared.value[0]
            lengths = (pivots**2).sum(1)
            for batch in batches:
                x = np.floor(_matrix(batch.column(1), dim))
                norms = np.sqrt((x**2).sum(1))
                near = lengths - 2 * (x @ pivots.T)
                cell = near.argmin(1)
                away = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, dim * len(x) + 1, dim), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), vectors, pa.array(cell, pa.int32()), pa.array(away), pa.array(norms)], ["id", "v", "cell", "away", "norm"])

        self.data = data = stored(base.mapInArrow(dealt, "id long, v array<double>, cell int, away double, norm double"), "cells")
        asks = F.col("id") % every == 0
        summary = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(asks.cast("long")).alias("queries"), F.max("away").alias("away"), F.max("norm").alias("norm")).collect()
        cells = {r.cell: r for r in summary}  # MOST_PIVOTS rows at most
        self.n_cells = len(cells)
        radius = np.array([cells[c].away if c in cells else -1.0 for c in range(len(pivots))])
        longest = np.array([cells[c].norm if c in cells else 0.0 for c in range(len(pivots))])

        # Blocks: cells with few queries share one, cells with many have several.
        first, parts, block, filled = {}, {}, 0, 0
        for c in sorted(cells, key=lambda c: (float(pivots[c] @ pivots[0]), c)):
            asked = cells[c].queries
            if filled and filled + asked > most:
                block, filled = block + 1, 0
            parts[c] = max(1, -(-asked // most))
            first[c] = block
            block, filled = (block + parts[c], 0) if parts[c] > 1 else (block, filled + asked)
        limits = spark.sparkContext.broadcast((radius, longest))

        def wanted(batches):
            (pivots, pool, pool_ids), (radius, longest) = shared.value, limits.value
            lengths = np.sqrt((pivots**2).sum(1))
            for whole in batches:
                for batch in (whole.slice(at, 1024) for at in range(0, len(whole), 1024)):
                    q, ids = _matrix(batch.column(1), dim), batch.column(0).to_numpy()
                    norms = np.sqrt((q**2).sum(1))
                    scores = q @ pool.T
                    scores[ids[:, None] == pool_ids[None, :]] = -np.inf
                    slack = 1e-9 * (1 + norms * max(1.0, float(longest.max())))
                    sure = np.partition(scores, -k, axis=1)[:, -k] - slack if len(pool) >= k else np.full(len(q), -np.inf)
                    bound = np.minimum(q @ pivots.T + norms[:, None] * radius, norms[:, None] * longest)
                    bound += 1e-9 * (1 + norms[:, None] * (lengths + radius))
                    need = (bound >= sure[:, None]) & (radius >= 0)
                    lists = [np.nonzero(x)[0].tolist() for x in need]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sure), pa.array(lists, pa.list_(pa.int32()))], ["id", "v", "cell", "sure", "cells"])

        # Rows that repeat an id and a vector ask once.
        asked = data.filter(asks).select("id", "v", "cell").dropDuplicates(["id", "v"])
        queries = asked.mapInArrow(wanted, "id long, v array<double>, cell int, sure double, cells array<int>")
        plan = spark.createDataFrame([(c, first[c], parts[c], max(1, -(-r.n // piece))) for c, r in cells.items()], "cell int, first int, parts int, pieces int")
        self.plan = F.broadcast(plan)  # MOST_PIVOTS rows at most
        in_block = F.col("first") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")
        self.queries = stored(queries.join(self.plan, "cell").select("id", "v", "sure", "cells", in_block.alias("block")), "queries")


def pruned_share(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> float:
    """The share of (query, cell) pairs that the bounds rule out."""
    cells = _Cells(rows, k, every, id_col, vector_col, scale)
    if not cells.n:
        return 0.0
    asked, needed = cells.queries.agg(F.count(F.lit(1)), F.sum(F.size("cells"))).first()
    return 1 - needed / (asked * cells.n_cells) if asked else 0.0


def top_k(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Queries are the rows whose id is divisible by every. Per query its k best other rows (all, if fewer): query_id, rank from 1, vec_id, score.

    Components become floor(scale * x); a score is their whole inner product, ties go to the smaller id. Rows with a null id, a null
    vector or a null or non-finite component take no part; shorter vectors count as padded with zeros. Rows that repeat an id are
    candidates each, but never for a query with that id. Rows that repeat a query's id and vector ask once; if its vectors differ, each asks, and the
    id's one list holds the k highest scores that any of them has, so that a candidate can stand in it once for each vector. An empty
    table gives no rows; further columns are ignored. Scores beyond 64 bits are cut off there.
    """
    spark = rows.sparkSession
    cells = _Cells(rows, k, every, id_col, vector_col, scale)
    if not cells.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").withColumnsRenamed({"vec_id": id_col})
    dim, data, queries, plan = cells.dim, cells.data, cells.queries, cells.plan
    pieces = plan.select("cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    pairs = queries.select("block", F.explode("cells").alias("cell")).distinct().join(F.broadcast(pieces), "cell")
    in_piece = F.pmod(F.xxhash64("id", F.lit(2)), F.col("pieces")).cast("int")
    left = queries.select("id", "v", "sure", "block", F.explode("cells").alias("cell")).join(F.broadcast(pieces), "cell")
    right = data.join(plan, "cell").select("id", "v", "cell", in_piece.alias("piece")).join(pairs, ["cell", "piece"])
    right = right.select(*(F.col(c).alias(c) for c in ("id", "v", "block", "cell", "piece")))  # columns apart from those of left

    def solved(key, q, x):
        if not q.num_rows or not x.num_rows:
            a = i = s = np.zeros(0, np.int64)
            ids = a
        else:
            ids = q["id"].to_numpy()
            a, i, s = _best(_matrix(q["v"], dim), ids, _matrix(x["v"], dim), x["id"].to_numpy(), q["sure"].to_numpy(), k)
        return pa.table({"query_id": pa.array(ids[a], pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    keys = ["block", "cell", "piece"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solved, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
