"""Exact top-k search by distributed histogram selection.

All scores of a block of queries against all vectors are counted into
histograms, which are added up over the partitions; the bin that holds each
query's kth score is refined until it is one score wide; then the scores above
it, and the smallest ids at it, are the result. Scores are computed again for
each round, in pieces, and never kept. Vectors stay where they are read: blocks
of queries, of bounded size, are broadcast to them one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainline.llm.common import Appended, ceil_div, written

#: Bounds of a block of queries: their number, and the numbers in their vectors.
QUERY_BLOCK, QUERY_NUMBERS = 1024, 1 << 20
#: Vectors scored at once.
VECTOR_BLOCK = 2048
BINS = 128
LONG = 2**63 - 1
FOUND = "query int, vec_id long, score long, beyond binary"


def usable(vector: Column) -> Column:
    """True where a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def _matrix(flat: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Vectors one after the other as a matrix, short ones filled with zeros."""
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _floored(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles where these are exact, else Python integers."""
    with np.errstate(over="ignore"):
        out = np.floor(x * scale)
    if np.isfinite(out).all():
        return out
    # beyond 2^53 a double is a whole number
    whole = [int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def _integers(x: np.ndarray) -> np.ndarray:
    """Whole numbers as Python integers."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products of floored vectors: in floating point where no
    sum can pass 2^53, in Python integers where one could pass a long."""
    peak = lambda x: float(np.abs(x).max(initial=0)) if x.dtype != object else math.inf
    with np.errstate(over="ignore"):
        bound = peak(q) * peak(v) * q.shape[1]
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    if bound < 2**53:
        return (q @ v.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    return _integers(q) @ _integers(v).T


def _as_numbers(values: list[int]) -> np.ndarray:
    """A column of longs, or of Python integers where these do not fit."""
    fits = all(abs(v) < 2**62 for v in values)
    return np.array(values, np.int64 if fits else object)[:, None]


def _pieces(batches: Iterator[pa.RecordBatch], shipped: tuple, scale: int):
    """(vector ids, scores of all queries, mask without each query's own row) of
    some vectors at a time."""
    q_rows, q_sizes, q_flat = shipped
    for batch in batches:
        for at in range(0, batch.num_rows, VECTOR_BLOCK):
            part = batch.slice(at, VECTOR_BLOCK)
            x = part.column("x")
            sizes = np.diff(x.offsets.to_numpy())
            width = int(max(q_sizes.max(initial=0), sizes.max(initial=0)))
            q = _floored(_matrix(q_flat, q_sizes, width), scale)
            v = _floored(_matrix(x.flatten().to_numpy(zero_copy_only=False), sizes, width), scale)
            yield part.column("id").to_numpy(), _scores(q, v), q_rows[:, None] != part.column("row").to_numpy()[None, :]


def _histograms(shipped, scale: int, k: int, low: list[int], width: int):
    """Counts by (query, bin) of the scores inside each query's range, added up
    over a partition. Bins below the one that brings its count to k are left
    out: the kth score of all vectors is no lower."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = _as_numbers(low)
        counts = np.zeros((len(low), BINS + 1), np.int64)
        for _, scores, other in _pieces(batches, shipped.value, scale):
            off = scores - lows if width < 2**62 else scores.astype(object) - lows
            inside = other & (off >= 0).astype(bool)
            bin_ = np.minimum(off // width, BINS)  # the last: above the range
            code = np.arange(len(low))[:, None] * (BINS + 1) + np.where(inside, bin_, 0).astype(np.int64)
            counts += np.bincount(code[inside], minlength=counts.size).reshape(counts.shape)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        row, col = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(counts[row, col])], ["query", "bin", "n"])

    return run


def _best(shipped, scale: int, k: int, kth: list[int], bound: int):
    """Scores above each query's kth, and at it the smallest ids that a piece
    could give. ``beyond`` orders the scores that a long cannot tell apart."""
    size = (2 * bound).bit_length() // 8 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = _as_numbers(kth)
        for ids, scores, other in _pieces(batches, shipped.value, scale):
            order = np.argsort(ids, kind="stable")
            scores, other, ids = scores[:, order], other[:, order], ids[order]
            at = other & (scores == last).astype(bool)
            keep = (other & (scores > last).astype(bool)) | (at & (at.cumsum(axis=1) <= k))
            row, col = np.nonzero(keep)
            exact = scores[row, col]
            beyond = [None] * len(exact)
            if exact.dtype == object:
                beyond = [(s + bound).to_bytes(size, "big") if abs(s) >= LONG else None for s in exact]
                exact = np.array([max(-LONG, min(LONG, s)) for s in exact], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row.astype(np.int32)), pa.array(ids[col]), pa.array(exact), pa.array(beyond, pa.binary())],
                ["query", "vec_id", "score", "beyond"])

    return run


def _kth_scores(rows: DataFrame, shipped, scale: int, k: int, n_queries: int, bound: int) -> list[int]:
    """Each query's kth highest score, or a number no higher than its lowest
    where it has fewer. The histograms that reach the driver hold BINS numbers a query."""
    low, width = [-bound] * n_queries, max(1, ceil_div(2 * bound + 1, BINS))
    while True:
        bins = rows.mapInArrow(_histograms(shipped, scale, k, low, width), "query int, bin int, n long")
        counts = np.zeros((n_queries, BINS + 1), np.int64)
        for r in bins.groupBy("query", "bin").agg(F.sum("n").alias("n")).collect():
            counts[r["query"], r["bin"]] = r["n"]
        # the highest bin that brings the count to k; the lowest one where there are fewer scores
        reached = counts[:, ::-1].cumsum(axis=1)[:, ::-1] >= k
        at = np.where(reached.any(axis=1), BINS - reached[:, ::-1].argmax(axis=1), 0)
        low = [v + int(a) * width for v, a in zip(low, at)]
        if width == 1:
            return low
        width = max(1, ceil_div(width, BINS))


def top_k(vectors: DataFrame, queries: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row for which
    ``queries`` (an SQL condition on ``id``) holds, its ``k`` highest integer inner
    products with the other rows, ties to the smaller id; all, if there are
    fewer.

    Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part. Rows that share an id are rows each: each is a
    candidate of the others, and each that is a query has ranks of its own.
    Components that a shorter vector lacks count as zero, and an empty vector
    scores zero. Components and scores may be of any size: scores are ranked as
    exact integers, and one that a long does not hold is given as the nearest of
    -(2^63 - 1) and 2^63 - 1. Empty tables and empty query sets give no rows.
    Other columns are not read.

    The vectors are written once and never shuffled; a round of a block of
    queries reads them once, and sends at most k bins of a query's histogram
    from each partition. The number of rounds depends on the range of scores only.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("x"))).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("is_query", F.coalesce(F.expr(queries), F.lit(False))), "vectors")
    # floor(scale * x) is at most scale * |x| + 1 in size
    longest, peak, nq = rows.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs))), F.count_if("is_query")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not nq:
        return spark.createDataFrame([], empty)
    bound = (scale * math.ceil(peak or 0.0) + 1) ** 2 * max(1, longest)
    # hashed dealing makes blocks of about half the bound, whatever the ids
    most = max(1, min(QUERY_BLOCK, QUERY_NUMBERS // max(1, longest)))
    n_blocks = ceil_div(2 * nq, most) if nq > most else 1
    asked = rows.filter("is_query").select("row", "id", "x", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"))
    asked = written(asked, "queries", partition_by="block")
    found = Appended(spark, "found", "query_id long, query_row long, vec_id long, score long, beyond binary")
    rows = rows.select("row", "id", "x")
    for b in range(n_blocks):
        held = asked.filter(F.col("block") == b).select("row", "id", "x").toArrow()
        if not held.num_rows:
            continue
        x = held.column("x").combine_chunks()
        x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
        q_rows = held.column("row").to_numpy()
        shipped = spark.sparkContext.broadcast((q_rows, np.diff(x.offsets.to_numpy()), x.flatten().to_numpy(zero_copy_only=False)))
        kth = _kth_scores(rows, shipped, scale, k, len(q_rows), bound)
        best = rows.mapInArrow(_best(shipped, scale, k, kth, bound), FOUND)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id"))
        best = best.withColumn("rank", rank).filter(F.col("rank") <= k)
        named = spark.createDataFrame([(i, int(r), int(d)) for i, (r, d) in enumerate(zip(q_rows, held.column("id").to_pylist()))],
                                      "query int, query_row long, query_id long")
        found.add(best.join(F.broadcast(named), "query").select("query_id", "query_row", "vec_id", "score", "beyond"))
        shipped.unpersist()
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id"))
    return found.read().withColumn("rank", rank.cast("int")).select("query_id", "rank", "vec_id", "score")
