"""An inverted-file index of vectors: lists about the centres of a spherical k-means, a table dealt by list, probed joins.

Centres are fitted to a bounded sample of the vectors, every vector is put into the list of its
nearest centre. A query is compared with the vectors of the lists whose centres lie nearest to
it; with all lists probed the result is that of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.operators.aggregates import index_lists
from fathomgrid.session import written


_SENT = 20_000  # queries that are sent to a list at once


@dataclass(frozen=True)
class Lists:
    """``rows(list, shard, id, x)`` with x of length one, and the lists' centres, as many rows as there are lists."""

    rows: DataFrame
    centres: np.ndarray
    shards: dict[int, int]


def _unit(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, x`` of vectors that aren't null, zero or without finite components, divided by their length."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    return kept.withColumn("size", size).filter("size > 0").select("id", F.transform("x", lambda v: v / F.col("size")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_centres(sample: DataFrame, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of ``sample(id, x)``: a round is one pass, whose tasks send a sum a list; lists without vectors stay.

    The first centres are the rows with the smallest seeded hashes.
    """
    start = sample.orderBy(F.xxhash64(F.lit(seed), "id", "x")).limit(lists).collect()
    centres = np.array([r.x for r in start])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centres), np.zeros(len(centres), int)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["x"])
            best = (x @ centres.T).argmax(1)
            np.add.at(total, best, x)
            n += np.bincount(best, minlength=len(centres))
        used = np.flatnonzero(n)  # none in a task without vectors
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].tolist(), pa.list_(pa.float64()))], names=["list", "total"])

    for _ in range(rounds):
        parts = sample.select("x").mapInArrow(sums, "list int, total array<double>")
        new = centres.copy()
        for r in parts.select("list", F.posexplode("total").alias("at", "v")).groupBy("list", "at").agg(F.sum("v").alias("v")).collect():
            new[r.list, r.at] = r.v
        size = np.sqrt((new**2).sum(1, keepdims=True))
        centres = np.where(size > 0, new / np.where(size > 0, size, 1), centres)
    return centres


def build_lists(vectors: DataFrame, id_col: str, vector_col: str, lists: int | None = None, rounds: int = 8, sample_per_list: int = 256, shard_rows: int = 20_000, seed: int = 5) -> Lists:
    """The index of all usable vectors, written to the shared folder.

    The smallest vector by hash sets the length; vectors of another length take no part, as do null,
    zero and non-finite ones and those with a null id. Centres are fitted to at most
    ``sample_per_list`` vectors a list, those of the smallest hashes. A list is dealt to shards of about
    ``shard_rows``, so that a full list isn't one task.
    """
    rows = written(_unit(vectors, id_col, vector_col))
    first = rows.orderBy(F.xxhash64(F.lit(seed), "id", "x")).select(F.size("x").alias("n")).first()
    if first is None:
        return Lists(rows.select(F.lit(0).alias("list"), F.lit(0).alias("shard"), "id", "x"), np.zeros((0, 0)), {})
    rows = rows.filter(F.size("x") == first.n)
    n, usual = rows.agg(F.count("*"), index_lists(F.count("*"))).first()
    lists = min(n, lists or usual)
    share = min(1.0, lists * sample_per_list / n)
    sample = written(rows.filter(F.pmod(F.xxhash64(F.lit(seed), "id", "x"), F.lit(1 << 20)) < int(share * (1 << 20)))) if share < 1 else rows
    centres = fit_centres(sample, lists, rounds, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = (_matrix(batch["x"]) @ centres.T).argmax(1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), batch["id"], batch["x"]], names=["list", "id", "x"])

    dealt = written(rows.mapInArrow(place, "list int, id long, x array<double>"))
    shards = {r.list: -(-r.n // shard_rows) for r in dealt.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    known = dealt.sparkSession.createDataFrame([(k, v) for k, v in shards.items()], "list int, shards int")
    salted = dealt.join(F.broadcast(known), "list").select("list", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"), "id", "x")
    return Lists(written(salted.repartition("list", "shard").sortWithinPartitions("list", "shard")), centres, shards)


def search_lists(index: Lists, queries: DataFrame, query_col: str, vector_col: str, probes: int, limit: int = 20, threshold: float | None = None, block_rows: int = 256) -> DataFrame:
    """``query_id, id, similarity, rank``: the ``limit`` most similar vectors of the ``probes`` nearest lists of each query, ties by id.

    Similarity is the cosine; only those above ``threshold`` are returned, if it is given. Queries are
    taken like vectors; of several of one id the smallest, component by component, counts. A task holds a
    shard of a list and a block of the queries that probe it.
    """
    asked = _unit(queries, query_col, vector_col).filter(F.size("x") == index.centres.shape[1]).groupBy("id").agg(F.min("x").alias("x"))
    centres, shards, probes = index.centres, index.shards, min(probes, len(index.centres))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near = np.argsort(-(_matrix(batch["x"]) @ centres.T), axis=1, kind="stable")[:, :probes]
            pairs = [(row, at, s) for row, lists in enumerate(near.tolist()) for at in lists for s in range(shards.get(at, 0))]
            row, at, shard = (np.array(c, np.int32) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int32),) * 3
            for start in range(0, len(row), _SENT):
                some = slice(start, start + _SENT)
                take = pa.array(row[some])
                yield pa.RecordBatch.from_arrays([pa.array(at[some]), pa.array(shard[some]), batch["id"].take(take), batch["x"].take(take)], names=["list", "shard", "id", "x"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, bool], pa.RecordBatch]]:
        """Slices of one shard and kind of row."""
        for batch in batches:
            key = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("list", "shard", "asks")])
            ends = [*(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(batch)] if len(batch) else []
            for at, end in zip([0, *ends], ends, strict=False):
                yield (int(key[0, at]), int(key[1, at]), bool(key[2, at])), batch.slice(at, end - at)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for (at, shard, asks), batch in runs(batches):
            if (at, shard) != place:
                place, held = (at, shard), []
            if not asks:
                held.append(batch)
                continue
            if not held:
                continue
            if len(held) > 1 or not isinstance(held[0], tuple):
                order = np.argsort(ids := np.concatenate([b["id"].to_numpy() for b in held]), kind="stable")
                held = [(ids[order], np.concatenate([_matrix(b["x"]) for b in held])[order])]
            ids, x = held[0]
            for start in range(0, len(batch), block_rows):
                some = batch.slice(start, block_rows)
                found = _matrix(some["x"]) @ x.T
                if len(ids) > limit:  # all that tie with the last, to within rounding, stay
                    bound = np.partition(found, len(ids) - limit, axis=1)[:, len(ids) - limit] - 1e-9
                else:
                    bound = np.full(len(some), -np.inf)
                if threshold is not None:
                    bound = np.maximum(bound, threshold - 1e-9)
                row, column = np.nonzero(found >= bound[:, None])
                yield pa.RecordBatch.from_arrays([some["id"].take(pa.array(row)), pa.array(ids[column]), pa.array(found[row, column])], names=["query_id", "id", "similarity"])

    base = index.rows.withColumn("asks", F.lit(False))
    asking = asked.mapInArrow(probe, "list int, shard int, id long, x array<double>").withColumn("asks", F.lit(True))
    if not len(centres):
        return asked.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    # shards no query probes are left out before vectors are dealt
    used = asking.select("list", "shard").distinct()
    dealt = base.join(F.broadcast(used), ["list", "shard"], "left_semi") if sum(shards.values()) <= 200_000 else base.join(used, ["list", "shard"], "left_semi")
    local = dealt.unionByName(asking).repartition("list", "shard").sortWithinPartitions("list", "shard", "asks").mapInArrow(score, "query_id long, id long, similarity double")
    rows = local if threshold is None else local.filter(F.col("similarity") > threshold)
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "id", "similarity", "rank")
