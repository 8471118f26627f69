"""Near-duplicate documents: SimHash signatures over vantage-point shards, exact five-word check.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is at least 0.8. Candidates come from 192-bit SimHash signatures of the set
of word pairs, which an edit disturbs less than longer shingles. A signature is eight
fingerprints of 24 bits; candidates agree up to two bits in one of them, so all pairs
of signatures up to 23 bits apart are found, and pairs with a similarity of 0.8 that
lie further apart with a probability of 0.93 or more. Each fingerprint is searched
through the vantage-point tree, among texts of similar size. Texts that agree in one of
20 bands of five least shingle hashes are candidates too: at a similarity of 0.8 these
miss one pair in 3,000, independently of the signatures.

By signature alone, pairs more than 42 bits apart are left to the bands.

Of the candidates only the components are kept, so a shard gives a spanning forest.
Inside a component every pair of texts that no verified chain connects yet is checked
with the whole shingle sets; which edges span a component doesn't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOWHERE, materialise, sized_join
from .components import connected_components
from .simhash import shingle_hashes
from .vptree import blocks, build, route

PARTS, BITS, RADIUS = 8, 24, 2
SHINGLE, SIMILAR = 5, 0.8
_BAND = 1 / SIMILAR**2  # sizes of a band; a partner is in the same band or the next
_FAR = 42  # differing bits of 192: three deviations beyond the mean of pairs with a similarity of 0.8
_KEY = ["owner", "text_hash"]
_CELLS = 1 << 20  # pairs that are compared at once
BANDS, ROWS = 20, 5  # bands of least hashes and hashes of a band
_ODD = np.random.default_rng(11).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """192 votes over distinct feature hashes, each hash spread to three words."""
    votes = np.zeros(PARTS * BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        h = hashes[at : at + 8192]
        wide = np.stack([h, (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15), (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)], axis=1)
        wide ^= wide >> np.uint64(32)
        votes += np.unpackbits(wide.view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes))


def least_bands(hashes: np.ndarray) -> np.ndarray:
    """One hash a band, of the least of the distinct ``hashes`` under five multipliers each."""
    if not len(hashes):
        return np.empty(0, np.int64)
    mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    least = np.array([(mixed * odd).min() for odd in _ODD]).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(least)], np.uint64).view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    schema = "owner long, text_hash long, node long, size int, sig binary, bands array<long>"

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, sig, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                node.append(xxhash.xxh64_intdigest(b" ".join(text.encode().lower().split())) if text else xxhash.xxh64_intdigest(b""))
                grams = np.unique(shingle_hashes(text, SHINGLE))
                size.append(len(grams))
                bands.append(least_bands(grams))
                sig.append(signature(np.unique(shingle_hashes(text, 2))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(*_KEY, "text").mapInArrow(signed, schema)


def _trees(texts: DataFrame, leaf: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The top of a tree for each part, from about 32 signatures a shard, picked by hash."""
    n = texts.count()
    depth = min(16, max(0, math.ceil(math.log2(max(n, 1) / (4 * leaf)))))
    every = max(1, n // (32 * 2**depth))
    sample = texts.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("sig").toPandas().sig if depth else []
    values = _fingerprints(pa.array(list(sample), pa.binary()))
    return [build(values[:, part], depth, RADIUS) for part in range(PARTS)]


def _dealt(texts: DataFrame, leaf: int) -> DataFrame:
    """``texts(node, size, sig)`` once for each fingerprint, band and shard: columns band, part, shard, home."""
    sent = texts.sparkSession.sparkContext.broadcast(_trees(texts, leaf))
    schema = "band int, part int, shard int, home boolean, node long, size int, sig binary"

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).to_numpy()
            band = np.floor(np.log(np.maximum(size, 1)) / math.log(_BAND) + 1e-9).astype(np.int64)
            high = np.floor(np.log(np.maximum(size, 1) / SIMILAR) / math.log(_BAND) + 1e-9).astype(np.int64)
            values = _fingerprints(batch.column(2))
            for part in range(PARTS):
                rows, shard = route(values[:, part], sent.value[part], RADIUS)
                next_band = high[rows] > band[rows]
                take = np.concatenate([rows, rows[next_band]])
                home = np.concatenate([np.ones(len(rows), bool), np.zeros(next_band.sum(), bool)])
                at = pa.array(take)
                columns = [pa.array((band[take] + ~home).astype(np.int32)), pa.repeat(pa.scalar(part, pa.int32()), len(take)), pa.array(np.concatenate([shard, shard[next_band]]).astype(np.int32)), pa.array(home)]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(i).take(at) for i in range(3))], names=[x.split()[0] for x in schema.split(", ")])

    return texts.select("node", "size", "sig").mapInArrow(dealt, schema)


def _paired(rows: DataFrame, n_blocks: Column) -> DataFrame:
    """Each row once for every pair ``i <= j`` of its group's ``n_blocks`` blocks that has its own, which goes by ``node``."""
    mine = F.pmod(F.xxhash64(F.lit(1), F.col("node")), n_blocks).cast("int")
    pair = lambda x: F.struct(F.least(mine, x).alias("i"), F.greatest(mine, x).alias("j"))
    return rows.withColumn("_pair", F.explode(F.transform(F.sequence(F.lit(0), n_blocks.cast("int") - 1), pair))).select("*", "_pair.i", "_pair.j").drop("_pair")


def _blocked(dealt: DataFrame, block: int) -> DataFrame:
    """``dealt`` with the columns i and j: shards of more than ``block`` rows as pairs of blocks of about ``block``."""
    key = ["band", "part", "shard"]
    large = materialise(dealt.groupBy(*key).agg(F.ceil(F.count("*") / block).alias("n_blocks")).filter("n_blocks > 1"))
    return _paired(sized_join(dealt, large, key, "left"), F.coalesce("n_blocks", F.lit(1))).drop("n_blocks")


def _fingerprints(sigs: pa.Array) -> np.ndarray:
    b = np.frombuffer(b"".join(sigs.to_pylist()), np.uint8).reshape(-1, PARTS, BITS // 8).astype(np.uint64)
    return b[..., 0] << np.uint64(16) | b[..., 1] << np.uint64(8) | b[..., 2]


class _Tree:
    """Union-find that says which of the offered pairs it took."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def offer(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        taken = np.zeros(len(a), bool)
        left = np.arange(len(a))
        while len(left):
            self.label()
            left = left[self.root[a[left]] != self.root[b[left]]]
            for i in left[:256].tolist():
                x, y = a[i], b[i]
                while self.root[x] != x:
                    x = self.root[x]
                while self.root[y] != y:
                    y = self.root[y]
                if x != y:
                    self.root[max(x, y)] = min(x, y)
                    taken[i] = True
            left = left[256:]
        return taken

    def label(self) -> np.ndarray:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]
        return self.root


def shard_edges(shard: pd.DataFrame, part: int) -> pd.DataFrame:
    """Candidate pairs of one shard, or of two blocks of one: a spanning forest of its candidate graph."""
    size, home, node = shard["size"].to_numpy(), shard.home.to_numpy(), shard.node.to_numpy()
    wide = np.frombuffer(b"".join(shard.sig), np.uint64).reshape(len(shard), -1)
    value = _fingerprints(pa.array(shard.sig, pa.binary()))[:, part].astype(np.uint32)
    forest, found = _Tree(len(shard)), []
    for rows in blocks(value, np.arange(len(shard)), RADIUS):
        step = min(512, max(1, _CELLS // len(rows)))
        for at in range(0, len(rows), step):
            mine = rows[at : at + step]
            label = forest.label()
            a, b = np.nonzero((np.bitwise_count(value[mine, None] ^ value[None, rows]) <= RADIUS) & (label[mine, None] != label[None, rows]))
            a, b = mine[a], rows[b]
            keep = (node[a] != node[b]) & (home[a] | home[b]) & (np.minimum(size[a], size[b]) >= SIMILAR * np.maximum(size[a], size[b]))
            a, b = a[keep], b[keep]
            near = np.bitwise_count(wide[a] ^ wide[b]).sum(1, dtype=np.int64) <= _FAR
            a, b = a[near], b[near]
            taken = forest.offer(a, b)
            found.append(np.stack([node[a[taken]], node[b[taken]]], axis=1))
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return pd.DataFrame(pairs, columns=["u", "v"])


def similar_edges(sets: list[np.ndarray], node: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the near copies among ``sets`` of distinct shingles, none of them empty."""
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    starts, mark = ends - size, np.zeros(ids.max() + 1, bool)
    forest, found = _Tree(len(sets)), []
    for x in range(len(sets) - 1):
        label = forest.label()
        if not ((label[x + 1 :] != label[x]) & (np.minimum(size[x + 1 :], size[x]) >= SIMILAR * np.maximum(size[x + 1 :], size[x]))).any():
            continue
        mark[ids[starts[x] : ends[x]]] = True
        after = starts[x + 1]
        shared = np.add.reduceat(mark[ids[after:]], starts[x + 1 :] - after, dtype=np.int64)
        mark[ids[starts[x] : ends[x]]] = False
        other = x + 1 + np.flatnonzero(shared >= SIMILAR * (size[x] + size[x + 1 :] - shared))
        other = other[forest.offer(np.full(len(other), x), other)]
        found += [(int(node[x]), int(node[y])) for y in other]
    return found


def _banded(texts: DataFrame) -> DataFrame:
    """Edges ``u, v`` from the first of the texts that agree in a band to the others."""
    keyed = texts.select("node", F.explode("bands").alias("key"))
    shared = materialise(keyed.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("v"), F.count("*").alias("n")).filter("n > 1"))
    return shared.filter("n = 2").select("u", "v").union(sized_join(keyed, shared.filter("n > 2").select("key", "u"), ["key"], "inner").filter("u <> node").select("u", "node"))


def _verified(docs: DataFrame, rows: DataFrame, loose: DataFrame, shingles: int) -> DataFrame:
    """Edges ``u, v`` that span the near copies within each component of ``loose(node, root)``.

    Small components are dealt to cells of about ``shingles`` shingles; one that has more
    is compared as pairs of blocks of about as many.
    """

    def verified(cell: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, group in cell.groupby("root"):
            out += similar_edges([np.unique(shingle_hashes(t, SHINGLE)) for t in group.text], group.node.to_numpy())
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    members = loose.select("node", "root").union(loose.select("root", "root").distinct()).toDF("n", "root")
    holder = materialise(rows.groupBy("node").agg(F.min(F.struct(*_KEY)).alias("at"), F.first("size").alias("size")).join(members, F.col("node") == F.col("n")).select("node", "root", "size", "at.*"))
    cells = max(1, math.ceil((holder.agg(F.sum("size")).first()[0] or 0) / shingles))
    large = materialise(holder.groupBy("root").agg(F.ceil(F.sum("size") / shingles).alias("n_blocks")).filter("n_blocks > 1"))
    placed = materialise(sized_join(holder.drop("size"), large, ["root"], "left"))
    texts = sized_join(docs, placed, _KEY, "inner").select("node", "root", "n_blocks", "text").dropDuplicates(["node"])
    cell = F.when(F.col("n_blocks").isNull(), F.pmod(F.xxhash64("root"), F.lit(cells))).otherwise(F.col("root"))
    paired = _paired(texts.withColumn("cell", cell), F.coalesce("n_blocks", F.lit(1)))
    return paired.select("cell", "i", "j", "node", "root", "text").groupBy("cell", "i", "j").applyInPandas(verified, "u long, v long")


def near_duplicates(docs: DataFrame, leaf: int = 2048, block: int = 16_384, shingles: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``owner, text_hash, kept_owner, kept_hash`` of every document that isn't its group's first.

    Groups are the components of near copies; the first of a group has the smallest
    id, null ids come last (owner 2**63 - 1). Texts equal but for A-Z case and white
    space are copies, texts without words (null and empty ones included) are copies of
    each other. Rows alike in id and text are one document. No rows give no rows.
    """
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NOWHERE)).alias("owner"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = materialise(_signed(keyed))
    texts = materialise(rows.groupBy("node").agg(F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).filter("size > 0"))
    # texts of one signature and size have the same candidates and are each other's, so one of them is dealt
    alike = materialise(texts.groupBy("sig", "size").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    placed = materialise(sized_join(texts, alike, ["sig", "size"], "left").select("node", "size", "sig", F.coalesce("least", "node").alias("least")))

    def local(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        return shard_edges(shard, key[1])

    dealt = _blocked(_dealt(placed.filter("node = least"), leaf), block)
    pairs = dealt.groupBy("band", "part", "shard", "i", "j").applyInPandas(local, "u long, v long").union(placed.filter("node <> least").select("least", "node")).union(_banded(texts))
    roots = connected_components(_verified(keyed, rows, connected_components(pairs), shingles))
    members = rows.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(*_KEY, F.coalesce("root", "node").alias("root"))
    kept = members.groupBy("root").agg(F.min(F.struct(*_KEY)).alias("kept"), F.max(F.struct(*_KEY)).alias("last")).filter("kept <> last").select(F.col("root").alias("group"), "kept")
    again = members.join(materialise(kept), F.col("root") == F.col("group")).filter(F.struct(*_KEY) != F.col("kept"))
    return again.select(*_KEY, F.col("kept.owner").alias("kept_owner"), F.col("kept.text_hash").alias("kept_hash")).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``docs`` with one document of each group of near copies; columns stay as they are.

    Of rows alike in id and text one stays, whatever their other columns hold.
    """
    gone = materialise(near_duplicates(docs, id_col=id_col, text_col=text_col, **options).select(F.col("owner").alias("__fg_owner"), F.col("text_hash").alias("__fg_hash")))
    key = ["__fg_owner", "__fg_hash"]
    keyed = docs.withColumns({"__fg_owner": F.coalesce(F.col(id_col).cast("long"), F.lit(NOWHERE)), "__fg_hash": F.coalesce(F.xxhash64(text_col), F.lit(0))})
    again = materialise(keyed.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    kept = sized_join(keyed, gone, key, "left_anti")
    single = sized_join(kept, again, key, "left_anti")
    return single.unionByName(sized_join(kept, again, key, "left_semi").dropDuplicates(key)).drop(*key)
