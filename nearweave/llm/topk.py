"""Exact top-k search by columnar branch-and-bound.

Vectors become integers, floor(scale * x), and lie in a vertical layout: one row for each dimension. Scores of a block of
candidates accumulate dimension block by dimension block. After each, a candidate stays for a query only if its partial
score plus the largest that the remaining dimensions can add (the product of both remaining norms, by Cauchy-Schwarz)
reaches the query's k-th best score so far; survivors are compacted before the next block. Queries are met in blocks of
bounded size, one after the other: a block is broadcast, held against every candidate partition, which sends on k rows
for each query, and released when its rows are written. So the candidates are read once for each block of queries.

Defined results: vectors that are null or hold null or non-finite components take no part, as queries or candidates;
candidates are those of the query's length; rows with the query's id are its own and are left out; a repeated query id
counts once (with its smallest vector); repeated candidates count each; ties go to the smaller id; an empty table gives
an empty result; other columns are ignored. Scores beyond the long range are clipped to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import Tables

#: Queries that are broadcast at once (by their bytes, too), and those that are met together by a block of candidates.
QUERY_BLOCK, QUERY_BYTES, QUERY_TILE = 32768, 64 << 20, 256
CANDIDATES = 4096
DIMENSIONS = 16


def usable(column: str) -> Column:
    c = F.col(column)
    return c.isNotNull() & F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return np.floor(flat * scale).reshape(-1, width)


class _Best:
    """The k best (score, id) of each query, by score and then smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        #: Candidates that the bounds left out, by the number of dimensions they were known in.
        self.left_out: dict[int, int] = {}

    def put(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        k = self.score.shape[1]
        order = sorted(range(len(s)), key=lambda x: (-s[x], i[x]))[:k] if s.dtype == object else np.lexsort((i, -s))[:k]
        self.score[q], self.id[q] = s[order], i[order]


def _search(best: _Best, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, wide: bool = False) -> None:
    """Meet one block of candidates (row by row here) with all queries; wide: sums are unbounded integers.

    Bounds are doubles, with room for their rounding; sums are exact.
    """
    width, k = queries.shape[1], best.score.shape[1]
    order = np.argsort(-(queries**2).sum(0), kind="stable")  # the dimensions that carry most mass come first
    vertical, turned = np.ascontiguousarray(rows[:, order].T), queries[:, order]
    left = lambda x, axis: np.sqrt(np.flip(np.cumsum(np.flip(x * x, axis), axis), axis))
    mass, own = left(vertical, 0), left(turned, 1)
    if wide:
        whole = lambda x: np.array([[int(v) for v in r] for r in x], object)
        vertical, turned = whole(vertical), whole(turned)
    head = min(DIMENSIONS, width)
    for a in range(0, len(queries), QUERY_TILE):
        partial = turned[a : a + QUERY_TILE, :head] @ vertical[:head]
        for q, sums in enumerate(partial, a):
            floor, at = best.score[q, -1], head
            alive = np.flatnonzero(ids != query_ids[q])
            sums = sums[alive]
            while len(alive):
                rough = sums.astype(np.float64)
                room = own[q, at] * mass[at, alive] * (1 + 1e-9) + 1e-6 if at < width else 0
                keep = rough + room + 1e-12 * np.abs(rough) >= float(floor) - 1e-12 * abs(float(floor)) if floor > -np.inf else np.ones(len(alive), bool)
                best.left_out[at] = best.left_out.get(at, 0) + len(keep) - int(keep.sum())
                alive, sums = alive[keep], sums[keep]
                if at == width or not len(alive):
                    break
                to = min(at + DIMENSIONS, width)
                if floor == -np.inf and len(alive) > 4 * k:  # no floor yet: the best by what is known give one
                    some = np.argpartition(-rough[keep], k - 1)[:k]
                    floor = min(sums[some] + turned[q, at:] @ vertical[at:, alive[some]])
                    continue
                sums = sums + turned[q, at:to] @ vertical[at:to, alive]
                at = to
            if len(alive) > 8 * k:  # ties at the k-th score stay
                least = np.partition(sums, len(sums) - k)[len(sums) - k] if not wide else sorted(sums)[-k]
                alive, sums = alive[sums >= least], sums[sums >= least]
            if len(alive):
                best.put(q, sums, ids[alive])


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the id and the score of the k best candidates of every query."""
    as_vector = lambda df: df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable("v") & (F.size("v") > 0))
    candidates, asked = as_vector(vectors), as_vector(queries).groupBy("id").agg(F.min("v").alias("v"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    with Tables(vectors.sparkSession) as tables:
        asked = tables.settle(asked)
        found = vectors.sparkSession.createDataFrame([], "query_id long, id long, score long")
        for width, n in sorted((r.w, r["count"]) for r in asked.groupBy(F.size("v").alias("w")).count().collect()):
            blocks = -(-n // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * width))))
            for b in range(blocks):
                mine = asked.filter((F.size("v") == width) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).orderBy("id").toArrow()
                if mine.num_rows:
                    part = _against(tables, candidates.filter(F.size("v") == width), np.asarray(mine.column("id")), _matrix(mine.column("v").combine_chunks(), width, scale), k, scale)
                    found = found.unionByName(part)
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return tables.keep(found.select("query_id", "rank", F.col("id").alias(id_column), "score"))


def _against(tables: Tables, candidates: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int, scale: int) -> DataFrame:
    """k best of each candidate partition for one block of queries, in a table of the run."""
    held = tables.spark.sparkContext.broadcast((query_ids, queries))

    def run(batches):
        query_ids, queries = held.value
        best, width = _Best(len(queries), k), queries.shape[1]
        most = np.abs(queries).max()
        wide = False
        for batch in batches:
            for a in range(0, batch.num_rows, CANDIDATES):
                piece = batch.slice(a, CANDIDATES)
                rows, ids = _matrix(piece.column(1), width, scale), np.array(piece.column(0))
                if not wide and most * np.abs(rows).max() * width >= 2**53:
                    best.score, wide = best.score.astype(object), True
                _search(best, queries, query_ids, rows, ids, wide)
        q, r = np.nonzero(best.id != np.iinfo(np.int64).max)
        top = 2**63 - 1
        scores = [max(-top - 1, min(top, int(s))) for s in best.score[q, r]]
        yield pa.record_batch([pa.array(query_ids[q], pa.int64()), pa.array(best.id[q, r], pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "id", "score"])

    out = tables.settle(candidates.mapInArrow(run, "query_id long, id long, score long"))
    held.destroy()
    return out
