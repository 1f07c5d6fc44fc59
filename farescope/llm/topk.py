"""Exact top-k search by distributed histogram selection.

Every query is scored against every row. Each round counts scores into bins of a
range per query and finds the bin that holds the k-th value; the range shrinks to
that bin until it is one integer wide. The last pass keeps the scores from the
k-th value up, and among ties at it the k smallest ids of each task.

A task scores blocks of rows with a matrix product. Queries come in blocks of
``QUERY_BLOCK``, so what is broadcast at once is bounded by that number times the
vector's length. Counts that a task sends are bounded too: bins below the task's own
k-th score cannot hold the k-th of all, so at most k bins per query and task are sent.

Defined cases: a vector that is NULL, is empty or holds a NULL or a non-finite
component takes no part, nor does a row without an id; vectors of another length than
the query score nothing against it; repeated ids are rows of their own, but a query
never meets a row with its own id; ties go to the smaller id; with fewer than k
candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.llm.common import saved

SCALE = 1024
QUERY_BLOCK = 2048
ROW_BLOCK = 512
BINS = 4096
EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """Whether a vector has components and all are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: int):
    """(ids, integer vectors as doubles) of the rows whose vectors have ``dim`` components."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        vectors = batch.column(1)
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        fit = np.flatnonzero(sizes == dim)
        for i in range(0, len(fit), ROW_BLOCK):
            part = fit[i : i + ROW_BLOCK]
            yield ids[part], np.floor(flat[starts[part, None] + np.arange(dim)] * scale)


def scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products, queries by rows, as int64.

    Doubles give them exactly while the bound on every partial sum is below 2**53;
    beyond it Python's integers do.
    """
    bound = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * rows.shape[1]
    if bound < EXACT:
        return (queries @ rows.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.asarray(exact(queries) @ exact(rows).T, dtype=np.int64)


def own(ids: np.ndarray, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, row) where a row has the query's own id."""
    order = np.argsort(query_ids, kind="stable")
    low = np.searchsorted(query_ids[order], ids, "left")
    high = np.searchsorted(query_ids[order], ids, "right")
    row = np.repeat(np.arange(len(ids)), high - low)
    at = np.concatenate([np.arange(a, b) for a, b in zip(low, high) if b > a] or [[]]).astype(int)
    return order[at], row


def _histograms(k, bins, dim, scale, query):
    """Task side: (query, bin, count) for the bins from the task's own k-th score up."""

    def run(batches):
        ids, vectors, low, high, width = query.value
        counts = np.zeros((len(ids), bins), np.int64)
        above = np.zeros(len(ids), np.int64)
        seen = False
        for row_ids, rows in blocks(batches, dim, scale):
            seen = True
            s = scores(rows, vectors)
            s[own(row_ids, ids)] = np.iinfo(np.int64).min
            over = s >= high[:, None]
            above += over.sum(1)
            q, r = np.nonzero((s >= low[:, None]) & ~over)
            np.add.at(counts, (q, (s[q, r] - low[q]) // width[q]), 1)
        if not seen:
            return
        from_top = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts  # counts in higher bins
        wanted = (counts > 0) & (from_top + above[:, None] < k)
        q, b = np.nonzero(wanted)
        yield pa.record_batch(
            [pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[q, b])],
            names=["query", "bin", "n"],
        )

    return run


def _winners(k, dim, scale, query):
    """Task side: every score above the k-th value, and the k smallest ids at it."""

    def run(batches):
        ids, vectors, kth = query.value
        held: dict[int, list[tuple[int, int]]] = {}
        for row_ids, rows in blocks(batches, dim, scale):
            s = scores(rows, vectors)
            keep = s >= kth[:, None]
            keep[own(row_ids, ids)] = False
            q, r = np.nonzero(keep)
            for i, v, score in zip(q.tolist(), row_ids[r].tolist(), s[q, r].tolist()):
                best = held.setdefault(i, [])
                best.append((-score, v))
                if len(best) >= 4 * k + 64:
                    best.sort()
                    del best[k:]
        out = [(i, int(ids[i]), v, -s) for i, best in held.items() for s, v in sorted(best)[:k]]
        if out:
            names = ["query", "query_id", "vec_id", "score"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def _search_block(rows: DataFrame, query_ids, vectors, k: int, scale: int, bins: int) -> DataFrame:
    """The k best rows of one block of queries."""
    context = rows.sparkSession.sparkContext
    squares = F.transform("vector", lambda x: F.pow(F.floor(x * float(scale)).cast("double"), 2.0))
    longest = rows.agg(F.max(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))).first()[0]
    reach = np.sqrt((vectors**2).sum(1)) * np.sqrt(longest or 0.0)  # no score is beyond it
    high = np.ceil(reach * (1 + 1e-9)).astype(np.int64) + 2
    lowest = -high
    n = len(query_ids)
    low = lowest.copy()
    need = np.full(n, k, np.int64)  # how many of the scores below ``high`` are wanted
    fewer = np.zeros(n, bool)
    while True:
        width = np.maximum(1, -((low - high) // bins))
        query = context.broadcast((query_ids, vectors, low, high, width))
        counts = (
            rows.mapInArrow(_histograms(k, bins, vectors.shape[1], scale, query), "query int, bin int, n long")
            .groupBy("query", "bin")
            .agg(F.sum("n").alias("n"))
        )
        down = Window.partitionBy("query").orderBy(F.col("bin").desc())
        over = F.col("so_far") - F.col("n")
        found = (
            counts.withColumn("so_far", F.sum("n").over(down))
            .join(_needs(rows, need), "query")
            .where(F.col("so_far") >= F.col("need"))
            .groupBy("query")
            .agg(F.max(F.struct("bin", over.alias("over"))).alias("hit"))
            .collect()  # one row per query of the block
        )
        reached = np.zeros(n, bool)
        for row in found:
            q = row["query"]
            reached[q] = True
            if not fewer[q]:
                low[q] += row.hit["bin"] * width[q]
                high[q] = min(high[q], low[q] + width[q])
                need[q] -= row.hit["over"]
        fewer |= ~reached  # fewer than k candidates: all are kept
        low[fewer], high[fewer] = lowest[fewer], lowest[fewer] + 1
        if (high - low <= 1).all():
            break
    query = context.broadcast((query_ids, vectors, low))
    return rows.mapInArrow(
        _winners(k, vectors.shape[1], scale, query), "query int, query_id long, vec_id long, score long"
    )


def _needs(rows: DataFrame, need: np.ndarray) -> DataFrame:
    return rows.sparkSession.createDataFrame(
        [(i, int(x)) for i, x in enumerate(need)], "query int, need long"
    )


def top_k(
    table: DataFrame,
    is_query: Column,
    k: int = 10,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    query_block: int = QUERY_BLOCK,
    bins: int = BINS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row where ``is_query`` holds."""
    rows = (
        table.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
        .select(
            F.col(vec_id).cast("long").alias("vec_id"),
            F.col(vector).cast("array<double>").alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("is_query"),
        )
    )
    asked = saved(rows.where("is_query").select("vec_id", "vector"), "topk-queries")
    candidates = rows.select("vec_id", "vector")
    results: DataFrame | None = None
    group = 0
    for block in _query_blocks(asked, query_block):
        for dim in sorted({len(v) for _, v in block}):
            group += 1
            part = [(i, v) for i, v in block if len(v) == dim]
            ids = np.array([i for i, _ in part], np.int64)
            vectors = np.floor(np.array([v for _, v in part], np.float64) * scale)
            found = saved(
                _search_block(candidates, ids, vectors, k, scale, bins).withColumn("block", F.lit(group)),
                "topk-found",
            )
            results = found if results is None else results.union(found)
    if results is None:
        return table.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score long"
        )
    best = Window.partitionBy("block", "query").orderBy(F.col("score").desc(), "vec_id")
    return (
        results.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _query_blocks(asked: DataFrame, size: int) -> Iterator[list[tuple[int, list[float]]]]:
    """The queries in blocks; the driver holds one block (and one fetched partition) at a time."""
    block = []
    for row in asked.orderBy("vec_id").toLocalIterator():
        block.append((row.vec_id, row.vector))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block
