"""Nearest neighbours by largest inner product: a block matrix join over int8 tiles.

Queries and candidates are dealt into blocks by a hash of their id, and every pair of blocks is one cell of a
grid. Within a cell both sides are quantised to int8 with a scale per row; the integer product of a tile, the
lengths of what quantisation left out and what rounding can add bound every score from both sides. Pairs that the
bounds cannot exclude are recomputed in double precision, and heaps merge the cells' best.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Rows of a block of candidates and of queries: a cell holds two blocks and one product tile.
CANDIDATES, QUERIES, TILE = 8192, 4096, 256
OUT = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what each row lost."""
    scale = np.abs(rows).max(1) / 127
    scale[scale == 0] = 1
    q = np.rint(rows / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(rows - q * scale[:, None], axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of aligned rows, components added in order: equal rows give equal sums."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def slack(q: np.ndarray, q_scale: np.ndarray, q_lost: np.ndarray, q8: np.ndarray, c: np.ndarray, c_lost: np.ndarray) -> np.ndarray:
    """How far the scaled product of int8 rows can be from the score that :func:`exact` computes, for each pair.

    By Cauchy and Schwarz quantisation takes at most |q8| * scale * c_lost + q_lost * |c|. Adding d products in double
    precision moves a score by less than (d + 1) * eps * |q| * |c|; scaling the product and the lengths themselves
    stay within a few such units, so four times d + 4 of them cover both sides. The last term stands for underflow.
    """
    eps = np.finfo(np.float64).eps
    c_len, q_len = np.linalg.norm(c, axis=1), np.linalg.norm(q, axis=1)
    q_hat = np.linalg.norm(q8.astype(np.float64), axis=1) * q_scale
    quantised = q_hat[:, None] * c_lost + q_lost[:, None] * c_len
    rounded = 4 * (q.shape[1] + 4) * eps * q_len[:, None] * c_len
    return quantised * (1 + 1e-9) + rounded + 1e-300


def cell_best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, candidate ids, scores) of each tile's best ``k`` per query, ties to smaller ids.

    Of candidates with equal vectors only the k + 1 smallest ids can be among a query's best, so a common vector
    costs no more than k + 1 rows.
    """
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], np.ascontiguousarray(c[order])
    _, kind = np.unique((c + 0.0).view(np.dtype((np.void, c.dtype.itemsize * c.shape[1]))).ravel(), return_inverse=True)
    by_kind = np.argsort(kind, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(kind[by_kind]) != 0])
    place = np.arange(len(kind)) - np.repeat(starts, np.diff(np.r_[starts, len(kind)]))
    kept = np.sort(by_kind[place <= k])
    c_ids, c = c_ids[kept], c[kept]
    c8, c_scale, c_lost = quantise(c)
    q8, q_scale, q_lost = quantise(q)
    # Products of int8 stay exact in float32 while a sum of them is below 2**24.
    exact_dims = (1 << 24) // (127 * 127)
    c_tile = c8.T.astype(np.float32)
    for at in range(0, len(q), TILE):
        rows = slice(at, at + TILE)
        product = np.zeros((len(q[rows]), len(c)))
        for d in range(0, q.shape[1], exact_dims):
            product += q8[rows, d : d + exact_dims].astype(np.float32) @ c_tile[d : d + exact_dims]
        product *= q_scale[rows, None] * c_scale
        error = slack(q[rows], q_scale[rows], q_lost[rows], q8[rows], c, c_lost)
        own = q_ids[rows, None] == c_ids
        low = np.where(own, -np.inf, product - error)
        if len(c) > k:
            floor = np.partition(low, len(c) - k, axis=1)[:, len(c) - k]
        else:
            floor = np.full(len(low), -np.inf)
        i, j = np.nonzero((product + error >= floor[:, None]) & ~own)
        scores = exact(q[rows][i], c[j])
        best = np.lexsort((c_ids[j], -scores, i))
        i, j, scores = i[best], j[best], scores[best]
        first = np.searchsorted(i, i)
        top = np.arange(len(i)) - first < k
        yield q_ids[rows][i[top]], c_ids[j[top]], scores[top]


def _side(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    ids = table.column("vec_id").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1).astype(np.float64)


def _cell(_: tuple, queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    found = [([], [], [])]
    if queries.num_rows and candidates.num_rows:
        found += list(cell_best(*_side(queries), *_side(candidates), k))
    q, c, s = (np.concatenate([np.asarray(x, kind) for x in column]) for column, kind in zip(zip(*found, strict=True), (np.int64, np.int64, np.float64), strict=True))
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})


def _merge(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    heaps: dict[int, list[tuple[float, int]]] = {}
    for batch in rows:
        for q, c, s in zip(*(batch.column(n).to_pylist() for n in ("query_id", "vec_id", "score")), strict=True):
            heap = heaps.setdefault(q, [])
            if len(heap) < k:
                heapq.heappush(heap, (s, -c))
            else:
                heapq.heappushpop(heap, (s, -c))
    out = [(q, rank, -c, s) for q, heap in heaps.items() for rank, (s, c) in enumerate(sorted(heap, reverse=True), 1)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)],
        ["query_id", "rank", "vec_id", "score"],
    )


def nearest(vectors: DataFrame, query: Column, k: int = 20, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products for each row that ``query`` picks.

    Candidates are all other usable rows of the same dimension; fewer than ``k`` are all returned. Unusable
    vectors (:func:`usable`) and null ids take no part. Rows that repeat an id are candidates of their own, never
    of their own id; as queries they count once, by their least vector. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col(vector).alias("v"), query.alias("_q")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("d", F.size("v"))
    n = rows.agg(F.count("*").alias("c"), F.count_if("_q").alias("q")).first()
    grid_c, grid_q = max(1, math.ceil(n.c / CANDIDATES)), max(1, math.ceil(n.q / QUERIES))
    asked = rows.where("_q").groupBy("vec_id", "d").agg(F.min("v").alias("v"))
    asked = asked.withColumn("i", F.pmod(F.xxhash64("vec_id"), F.lit(grid_q))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(grid_c - 1))))
    offered = rows.drop("_q").withColumn("j", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(grid_c)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid_q - 1))))
    key = ["d", "i", "j"]
    asked, offered = (x.withColumn("i", F.col("i").cast("int")) for x in (asked, offered))
    best = asked.groupBy(*key).cogroup(offered.groupBy(*key)).applyInArrow(lambda g, a, b: _cell(g, a, b, k), OUT)
    merged = best.repartition(partitions(spark), "query_id").mapInArrow(partial(_merge, k=k), "query_id long, rank int, vec_id long, score double")
    return merged
