"""Exact top-k search by inner product: Fagin's threshold algorithm.

Candidates are dealt into blocks by hash, and each block keeps a list for each dimension, sorted by that component. A
query walks down the lists from the end that suits the sign of its own component, some entries of each list at a time;
it scores every candidate that it meets whole, and stops when the sum of what the lists could still offer is below its
kth best score, or below a start: its kth best among a small share of the candidates, which is found first. A block
whose lists cannot reach the start at all is not looked at. Query blocks meet candidate blocks pair by pair, so that
nothing has to fit into one task but two blocks; the best of all blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, vec (array of longs, floor(scale * x)) of the rows that have finite components only."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * float(scale))).alias("vec"))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if rows else np.zeros(0, np.int64)
    return flat.reshape(rows, len(flat) // rows if rows else 0)


def _clipped(scores: np.ndarray) -> np.ndarray:
    """Scores beyond a long stop at its ends; only Python's integers (dtype object) can be so."""
    return np.minimum(np.maximum(scores, _LEAST), _MOST) if scores.dtype == object else scores


def search(query: np.ndarray, own: int, x: np.ndarray, ids: np.ndarray, order: np.ndarray, k: int, step: int = 16, start: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the k best candidates of one block; order: argsort of each column of x.

    With a start, candidates below it may be missing. Numbers are doubles, or Python's integers where doubles would not
    be exact.
    """
    n = len(x)
    dims = np.flatnonzero(query)
    seen = ids == own
    if not len(dims) or not n:
        rows = np.flatnonzero(~seen)
        rows = rows[np.argsort(ids[rows], kind="stable")[:k]]
        return rows, np.zeros(len(rows), dtype=x.dtype)
    falls = query[dims] > 0
    best, scores = np.zeros(0, np.int64), np.zeros(0, dtype=x.dtype)
    depth = 0
    while depth < n:
        offer = x[order[np.where(falls, n - 1 - depth, depth), dims], dims]
        bound = _clipped(np.asarray([offer @ query[dims]], dtype=x.dtype))[0]
        if start is not None and bound < start or len(best) == k and bound < scores[-1]:  # a tie could still have a smaller id
            break
        to = min(n, depth + step)
        at = np.where(falls, n - 1 - np.arange(depth, to)[:, None], np.arange(depth, to)[:, None])
        mark = np.zeros(n, dtype=bool)
        mark[order[at, dims]] = True
        mark &= ~seen
        new = np.flatnonzero(mark)
        seen |= mark
        best, scores = np.concatenate((best, new)), np.concatenate((scores, _clipped(x[new] @ query)))
        top = np.lexsort((ids[best], -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(best)), key=lambda i: (-scores[i], ids[best[i]]))[:k], dtype=np.int64)
        best, scores = best[top], scores[top]
        depth, step = to, 2 * step
    return best, scores


def _numbers(q: np.ndarray, x: np.ndarray) -> type:
    """Doubles if they hold every score of these vectors exactly, else Python's integers."""
    largest = [max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0 for m in (q, x)]
    return np.float64 if largest[0] * largest[1] * max(q.shape[1], 1) < 1 << 53 else object


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, query_block: int = 8192, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id of queries the k highest integer inner products, ties to smaller ids.

    Both tables have vec_id and embedding. Rows with a null vec_id or vector or with null or non-finite components take
    no part; candidates that repeat count each time, and queries that share a vec_id are searched each and their results
    merged; vectors of another length than the query's are no candidates, nor are rows with the query's own vec_id.
    Fewer candidates give fewer rows, empty tables an empty one. Components and scores beyond a long stop at its ends.
    Further columns are ignored; vectors of any length are taken, memory is in proportion to two blocks of them.
    """
    all_rows, asked = quantised(vectors, scale), quantised(queries, scale)
    n, n_asked = vectors.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_asked // query_block))
    bucket = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30))
    by_query = asked.select("vec_id", "vec", F.size("vec").alias("dim"), (bucket % query_blocks).cast("int").alias("q"))
    every_query_block = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))

    def meet(some: pa.Table, rows: pa.Table) -> pa.Table:
        ids, x = rows["vec_id"].to_numpy(), _matrix(rows["vec"], rows.num_rows)
        own, q = some["vec_id"].to_numpy(), _matrix(some["vec"], some.num_rows)
        starts = some["start"].to_pylist()
        out: list[tuple[int, int, int]] = []
        if len(x) and len(q):
            order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
            numbers = _numbers(q, x)
            q, x = q.astype(numbers), x.astype(numbers)
            for i, v, start in zip(own.tolist(), q, starts, strict=True):
                at, scores = search(v, i, x, ids, order, k, start=start)
                out += [(i, a, int(s)) for a, s in zip(ids[at].tolist(), scores.tolist(), strict=True)]
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        found = left.groupBy("dim", "q", "c").cogroup(right.groupBy("dim", "q", "c")).applyInArrow(meet, "query_id long, vec_id long, score long")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", best).where(F.col("rank") <= k)

    if blocks > 1:
        # one block's worth of candidates, taken by their hash, gives every query a start
        share = all_rows.where(F.pmod(F.xxhash64("vec", "vec_id"), F.lit(blocks)) == 0)
        first = met(by_query.withColumns({"c": F.lit(0), "start": F.lit(None).cast("long")}), share.select("vec_id", "vec", F.size("vec").alias("dim"), every_query_block.alias("q"), F.lit(0).alias("c")))
        starts = checkpointed(first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("start")))
        by_query = by_query.join(starts, "vec_id", "left")
    else:
        by_query = by_query.withColumn("start", F.lit(None).cast("long"))
    left = by_query.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = all_rows.select("vec_id", "vec", F.size("vec").alias("dim"), every_query_block.alias("q"), (bucket % blocks).cast("int").alias("c"))
    return met(left, right).select("query_id", "rank", "vec_id", "score")
