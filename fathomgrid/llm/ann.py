"""Nearest neighbours by collision counting over single-projection sorted arrays.

Inner products become distances by one more coordinate that makes all vectors equally
long. A shard of the vectors keeps, for each of ``projections`` directions, its
vectors sorted by their projection. A query opens a window around its own projection
in every array; a vector collides once for each window it lies in. Windows widen by
virtual rehashing, that is, the sorted arrays are read further outward and nothing is
hashed anew, until a small share of the vectors exceeds the collision threshold; those
are verified with their original components. Every vector is indexed, each shard's index
is built once, and the queries stream past it in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def directions(dim: int, projections: int, seed: int) -> np.ndarray:
    """Unit directions; orthogonal ones as far as there are that many."""
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < projections:
        parts.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0])
    return np.concatenate(parts, axis=1)[:, :projections]


class Index:
    """The sorted arrays of one shard."""

    def __init__(self, vectors: np.ndarray, longest: float, projections: int, seed: int) -> None:
        self.vectors, self.longest = vectors, longest
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        self.axes = directions(vectors.shape[1] + 1, projections, seed)
        values = np.column_stack([vectors, rest]) @ self.axes
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values, self.order.T, axis=0).T.copy()
        self.unit = float(values.std(axis=0).mean()) or 1.0

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, threshold: float, enough: float, start: float, growth: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, vector row and score of the ``k`` best verified, and all ties with the last.

        ``own`` holds the first of the query's own rows and the one behind the last.
        """
        n, m = len(self.vectors), len(self.order)
        size = np.sqrt((queries**2).sum(1, keepdims=True))
        middle = (queries / size * self.longest) @ self.axes[:-1]
        least, wanted = math.ceil(threshold * m), min(n, 4 * k + math.ceil(enough * n))
        spans, width = [], start * self.unit
        while True:  # the windows of all queries, of one width after the other, as they are asked for
            spans.append(np.stack([np.stack([np.searchsorted(self.sorted[j], middle[:, j] - width), np.searchsorted(self.sorted[j], middle[:, j] + width, "right")]) for j in range(m)], axis=2))
            if (spans[-1][0] == 0).all() and (spans[-1][1] == n).all():
                break
            width *= growth
        out: list[list[np.ndarray]] = [[], [], []]
        for q, vector in enumerate(queries):
            hits, before = np.zeros(n, np.int64), None
            for low, high in (s[:, q].tolist() for s in spans):
                if before is None:
                    new = [self.order[j, low[j] : high[j]] for j in range(m)]
                else:
                    new = [self.order[j, a:b] for j in range(m) for a, b in ((low[j], before[0][j]), (before[1][j], high[j])) if a < b]
                if new:
                    hits += np.bincount(np.concatenate(new), minlength=n)
                before = low, high
                found = np.flatnonzero(hits >= least)
                if len(found) >= wanted + own[q, 1] - own[q, 0]:
                    break
            found = found[(found < own[q, 0]) | (found >= own[q, 1])]
            score = self.vectors[found] @ vector
            if len(found) > k:
                found = found[score >= np.partition(score, len(found) - k)[len(found) - k] - 1e-9 * (1 + np.abs(score).max())]
            score = (self.vectors[found] * vector).sum(1)  # the same for equal vectors, wherever they stand
            for column, value in zip(out, (np.full(len(found), q), found, score), strict=True):
                column.append(value)
        return tuple(np.concatenate(c) for c in out)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda v: F.coalesce(v, F.lit(0.0)) != 0))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, projections: int = 64, threshold: float = 0.8, enough: float = 0.06, start: float = 1.0, growth: float = 1.12, shard_rows: int = 16_384, block_rows: int = 512, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found by inner product for every query.

    Queries are the ids divisible by ``every``, candidates all other rows of the same
    length; a query with no more than ``k`` candidates gets them all. Nearest first, ties
    to the smaller id. Null, zero and non-finite vectors, vectors with a null component
    and rows with a null id take no part. Copies are candidates like others, but rows that
    share the query's id aren't; if these hold different vectors, the shortest and among
    those the smallest, component by component, is the query. No rows give no rows.

    Windows widen until ``enough`` of a shard's vectors collide in ``threshold`` of the
    arrays. Vectors are dealt by hash to shards of about ``shard_rows``; a task holds the
    index of one and ``block_rows`` queries at a time.
    """
    rows = materialise(_usable(vectors, id_col, vector_col).withColumn("dim", F.size("x")))
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("norm")).first()
    shards, longest = max(1, math.ceil(stats.n / shard_rows)), math.sqrt(stats.norm or 0.0)
    base = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "x")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "x")).alias("v"))
    asked = asked.select("v.dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v.x")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, bool], pa.RecordBatch]]:
        """Batches cut where the vectors' length, the shard or the kind of row changes."""
        for batch in batches:
            kind = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            ends = [*(np.flatnonzero((kind[:, 1:] != kind[:, :-1]).any(0)) + 1).tolist(), len(batch)] if len(batch) else []
            for at, end in zip([0, *ends], ends, strict=False):
                yield (int(kind[0, at]), int(kind[1, at]), bool(kind[2, at])), batch.slice(at, end - at)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        place, held, index, ids = None, [], None, np.array([], np.int64)
        for (dim, shard, asks), batch in groups(batches):
            if (dim, shard) != place:
                place, held, index = (dim, shard), [], None
            if not asks:
                held.append((batch.column("vec_id").to_numpy(), _vectors(batch)))
                continue
            if held:
                ids = np.concatenate([i for i, _ in held])
                order = np.argsort(ids, kind="stable")
                ids, x, held = ids[order], np.concatenate([x for _, x in held])[order], []
                index = Index(x, longest, projections, seed)
            if index is None:  # no candidates of this length in the shard
                continue
            asking, queries = batch.column("vec_id").to_numpy(), _vectors(batch)
            for at in range(0, len(asking), block_rows):
                some = asking[at : at + block_rows]
                own = np.stack([np.searchsorted(ids, some), np.searchsorted(ids, some, "right")], axis=1)
                q, row, score = index.search(queries[at : at + block_rows], own, k, threshold, enough, start, growth)
                out = pd.DataFrame({"query_id": some[q], "vec_id": ids[row], "score": score})
                yield out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in search(batches):
            yield pa.RecordBatch.from_pandas(part, preserve_index=False)

    dealt = base.union(asked).repartition(8 * shards, "dim", "shard").sortWithinPartitions("dim", "shard", "asks")
    local = dealt.mapInArrow(found, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
