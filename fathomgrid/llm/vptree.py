"""Vantage-point trees over 64-bit fingerprints.

A node has a vantage fingerprint v and a radius mu. What lies within mu of v belongs
to its left side, the rest to its right side; by the triangle inequality a partner
within r of something on the left lies within mu + r of v, so the rest up to mu + r
is sent to the left side too, and no pair within r is lost. The top levels, built on
the driver from a sample of bounded size, cut the fingerprints into shards; inside a
shard the same rule goes on down to small blocks that are compared outright.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

_BLOCK = 512


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _vantage(values: np.ndarray) -> tuple[np.uint64, int]:
    """Of a few evenly spaced candidates the one with the widest spread, and its median distance."""
    tried = values[:: max(1, len(values) // 5)][:5]
    seen = values[:: max(1, len(values) // 2048)]
    best = max(tried, key=lambda v: distance(seen, v).astype(float).var())
    return best, int(np.median(distance(values, best)))


def build(sample: np.ndarray, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The top ``depth`` levels in heap order: vantage fingerprints and radii."""
    vantage, mu = np.zeros(2**depth - 1, np.uint64), np.full(2**depth - 1, 64, np.int64)
    held = {0: np.unique(sample)}
    for node in range(2**depth - 1):
        values = held.pop(node)
        if len(values) > 1:
            vantage[node], mu[node] = _vantage(values)
        d = distance(values, vantage[node])
        if 2 * node + 2 < 2**depth - 1 + 2**depth:
            held[2 * node + 1], held[2 * node + 2] = values[d <= mu[node] + radius], values[d > mu[node]]
    return vantage, mu


def route(values: np.ndarray, tree: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of ``values`` and the shards they go to."""
    vantage, mu = tree
    rows, node = np.arange(len(values)), np.zeros(len(values), np.int64)
    for _ in range(int(math.log2(len(vantage) + 1))):
        d = distance(values[rows], vantage[node]).astype(np.int64)
        left, right = d <= mu[node] + radius, d > mu[node]
        rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return rows, node - len(vantage)


def blocks(values: np.ndarray, rows: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Row sets of a shard such that every pair within ``radius`` is in one of them."""
    stack = [rows]
    while stack:
        rows = stack.pop()
        if len(rows) > _BLOCK:
            v, mu = _vantage(values[rows])
            d = distance(values[rows], v).astype(np.int64)
            left, right = rows[d <= mu + radius], rows[d > mu]
            if len(left) ** 2 + len(right) ** 2 < len(rows) ** 2:  # else the sides have more pairs than the whole
                stack += [left, right]
                continue
        yield rows


class Forest:
    """Union-find over row numbers; the smallest row number names a set."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while (label[label] != label).any():
                label[:] = label[label]


def components_of(values: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct ``values`` the row number of its component's first member."""
    forest = Forest(len(values))
    for rows in blocks(values, np.arange(len(values)), radius):
        for at in range(0, len(rows), _BLOCK):  # more than a block only where no vantage point splits it
            a, b = np.nonzero(distance(values[rows[at : at + _BLOCK], None], values[None, rows]) <= radius)
            forest.join(rows[at + a], rows[b])
    return forest.label


def shards(values: DataFrame, radius: int, leaf: int = 2048, max_depth: int = 16) -> DataFrame:
    """``values(fp long)``, distinct, with the ``shard`` numbers each belongs to.

    The depth follows the number of fingerprints. The tree is built from about 32
    fingerprints a shard, picked by hash, so at most 32 * 2**max_depth of them reach the
    driver and 2**max_depth nodes the executors.
    """
    n = values.count()
    depth = min(max_depth, max(0, math.ceil(math.log2(max(n, 1) / leaf))))
    every = max(1, n // (32 * 2**depth))
    sample = values.filter(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").toPandas().fp.to_numpy(np.int64).view(np.uint64) if depth else np.array([], np.uint64)
    sent = values.sparkSession.sparkContext.broadcast(build(sample, depth, radius))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            rows, shard = route(fp.view(np.uint64), sent.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array(shard.astype(np.int32))], names=["fp", "shard"])

    return values.select("fp").mapInArrow(routed, "fp long, shard int")


def paired(dealt: DataFrame, block: int) -> DataFrame:
    """``dealt(fp, shard)`` with the columns i and j: a shard of more than ``block`` fingerprints as pairs of its blocks of about that many.

    Any two fingerprints of a shard are together in a pair. There is a row a large shard to broadcast, so no more
    than the tree has leaves.
    """
    large = dealt.groupBy("shard").agg(F.ceil(F.count("*") / block).alias("n_blocks")).filter("n_blocks > 1")
    n = F.coalesce("n_blocks", F.lit(1))
    own = dealt.join(F.broadcast(large), "shard", "left").withColumn("own", F.pmod(F.xxhash64("fp"), n)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return own.filter("own <> other or n_blocks is null").select("fp", "shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def links(values: DataFrame, radius: int, block: int = 16_384, **options: int) -> DataFrame:
    """Edges ``u, v`` over distinct ``values(fp)`` with the connected components of all pairs within ``radius``.

    A group, that is a shard or a pair of a large shard's blocks, gives one edge for each
    member of a local component but its first, however many pairs there are; components
    that cross groups share members. No group holds much more than two blocks, as where many
    near copies can't be told apart by any vantage point.
    """

    def local(group: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(group.fp.to_numpy(np.int64))
        root = components_of(fp.view(np.uint64), radius)
        other = root != np.arange(len(fp))
        return pd.DataFrame({"u": fp[root[other]], "v": fp[other]})

    return paired(materialise(shards(values, radius, **options)), block).groupBy("shard", "i", "j").applyInPandas(local, "u long, v long")
