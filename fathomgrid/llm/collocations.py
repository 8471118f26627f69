"""Collocation mining with hashed buckets (PCY/DHP) and Apriori pruning.

One pass over the texts for each phrase length. A pass counts its phrases exactly, and in
the same pass counts the phrases of the next length by hash bucket. Two bitmaps then go to the
next pass: the buckets whose count reaches the bound, and the hashes of the phrases that reach
it. A longer phrase is counted only where its bucket is set and both the phrase without its
last word and that without its first word are. Bitmaps are hashed, so they may let a rare
phrase through, never a frequent one off; exact counts decide.

Words are numbered inside a block of text, by NumPy and Arrow; a task sends the distinct
phrases of a block with their counts. Scores, absorption and ranks are joins and
windows over the frequent phrases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, sized_join

_BLANK, _BREAK = 32, 10
_BYTES = np.arange(256, dtype=np.uint8)  # a byte of a text -> a letter in lower case, a blank or a break between pieces
_BYTES[ord("A") : ord("Z") + 1] += 32
_BYTES[[ord(c) for c in ".,;:!?\n\v\f\r"]] = _BREAK
_BYTES[9] = _BLANK

_BLOCK_BYTES = 2_000_000  # texts are numbered together up to about this size
_BATCH_BYTES = 4_000_000  # a task gets about this much at a time
_BATCH_ROWS = 32_768  # and sends this many phrases at a time,
_BATCH_SLABS = 32  # or slabs
_SLAB = 32_768  # buckets whose counts travel together, and bits of one bitmap of Spark's
_MIX = np.uint64(0x9E3779B97F4A7C15)


@contextmanager
def _bounded_batches(spark: SparkSession, size: int = _BATCH_BYTES) -> Iterator[None]:
    """Tasks get batches of about ``size`` bytes inside, a row at least: Spark holds a batch several times over, and 10,000 rows can be any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = _BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches, of like size, with about ``limit`` bytes of text, a row at least."""
    for batch in batches:
        if not len(batch):
            continue
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        share = max(1, ends[-1] / max(1, round(ends[-1] / limit)))
        at = 0
        while at < len(batch):
            end = min(len(batch), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + share)) + 1)
            yield batch.slice(at, end - at)
            at = end


class Block:
    """The words of some texts: numbers, the words they stand for, hashes, and which words the next one follows in its piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = _BYTES[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        first = np.zeros(len(raw) + 1, bool)
        first[offsets] = True  # a text begins
        inside = (raw != _BLANK) & (raw != _BREAK)
        begins = inside & (np.concatenate([[True], ~inside[:-1]]) | first[:-1]) if len(raw) else inside
        starts = np.flatnonzero(begins)
        piece = np.cumsum((raw == _BREAK) + first[:-1].astype(np.int8), dtype=np.int32)[starts]
        self.follows = np.append(piece[1:] == piece[:-1], False)[: len(starts)]
        text = np.searchsorted(offsets, starts, "right") - 1
        at = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, inside.sum()).astype(np.int32)
        named = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw[inside])]).dictionary_encode()
        self.words = named.dictionary
        self.number = named.indices.to_numpy().astype(np.int64)
        known = langs.dictionary_encode()
        self.langs = known.dictionary
        self.lang = known.indices.to_numpy()[text].astype(np.int64)
        digest = xxhash.xxh3_64_intdigest
        self.word_hash = np.array([digest(w) for w in self.words.to_pylist()], np.uint64)[self.number] if len(starts) else np.zeros(0, np.uint64)
        self.hash = self._mixed(np.array([digest(x.encode(), 1) for x in self.langs.to_pylist()], np.uint64)[self.lang], self.word_hash) if len(starts) else np.zeros(0, np.uint64)

    @staticmethod
    def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
        x = (before ^ (before >> np.uint64(29))) * _MIX + word
        return x ^ (x >> np.uint64(32))

    def longer(self, places: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of phrases of ``size`` words at ``places`` (ascending) those of one word more: both their parts are among ``places``."""
        if len(places) < 2:
            return places[:0], hashes[:0]
        next_too = np.append(places[1:] == places[:-1] + 1, False) & self.follows[np.minimum(places + size - 1, len(self.follows) - 1)]
        places, hashes = places[next_too], hashes[next_too]
        return places, self._mixed(hashes, self.word_hash[places + size])

    def distinct(self, places: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first place and the count of each phrase at ``places``."""
        _, first, which, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        same = self.lang[places] == self.lang[places[first[which]]]
        for j in range(size):
            same &= self.number[places + j] == self.number[places[first[which]] + j]
        if not same.all():  # two phrases of one hash: number them word by word
            which = self.lang[places]
            for j in range(size):
                _, first, which, n = np.unique(which * len(self.words) + self.number[places + j], return_index=True, return_inverse=True, return_counts=True)
        return places[first], n

    def spelled(self, places: np.ndarray, size: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.number[places + j])) for j in range(size)]
        return (pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]).cast(pa.string())


def _set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set."""
    at = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pass(texts: DataFrame, size: int, longest: int, least: int, buckets: int, maps: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Counts of the phrases of ``size`` words that the bitmaps ``maps`` of the shorter ones let through, by block, and bucket counts of the next size, by task.

    ``maps`` has the bitmap of the frequent phrases of a size and that of the buckets of the next, from one word on.
    """
    schema = "lang string, phrase string, hash long, n long, slab int, counts binary"
    arrow = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("hash", pa.int64()), ("n", pa.int64()), ("slab", pa.int32()), ("counts", pa.binary())])
    kind = np.uint8 if least < 256 else np.uint32  # counts stop at the bound

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(buckets, kind) if size < longest else None
        for rows in _blocks(batches):
            block = Block(rows.column("text"), rows.column("lang"))
            places, hashes = np.arange(len(block.number)), block.hash
            for k, (frequent, bucket) in enumerate(maps, 1):
                kept = _set(frequent, hashes)
                places, hashes = block.longer(places[kept], hashes[kept], k)
                kept = _set(bucket, hashes)
                places, hashes = places[kept], hashes[kept]
            if len(places):
                first, n = block.distinct(places, hashes, size)
                own = hashes[np.searchsorted(places, first)].view(np.int64)
                lang = block.langs.take(pa.array(block.lang[first])).cast(pa.string())
                sent = pa.RecordBatch.from_arrays([lang, block.spelled(first, size), pa.array(own), pa.array(n.astype(np.int64)), pa.nulls(len(first), pa.int32()), pa.nulls(len(first), pa.binary())], schema=arrow)
                for start in range(0, len(sent), _BATCH_ROWS):
                    yield sent.slice(start, _BATCH_ROWS)
            if filled is not None:
                _, further = block.longer(places, hashes, size)
                at, n = np.unique((further & np.uint64(buckets - 1)).astype(np.int64), return_counts=True)
                filled[at] = np.minimum(filled[at] + n, least)
        if filled is not None:
            slabs = filled.reshape(-1, min(_SLAB, buckets))
            used = np.flatnonzero(slabs.any(1))
            for start in range(0, len(used), _BATCH_SLABS):
                part = used[start : start + _BATCH_SLABS]
                nothing = [pa.nulls(len(part), t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*nothing, pa.array(part.astype(np.int32)), pa.array([slabs[i].tobytes() for i in part.tolist()], pa.binary())], schema=arrow)

    return texts.mapInArrow(count, schema)


def _full_buckets(counts: DataFrame, least: int, buckets: int) -> np.ndarray:
    """The bitmap of the buckets whose counts of all tasks sum to ``least``; a task adds up slabs as they come."""
    kind = np.uint8 if least < 256 else np.uint32
    width = min(_SLAB, buckets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, packed in zip(batch.column("slab").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                new = np.frombuffer(packed, kind).astype(np.uint32)
                sums[slab] = np.minimum(sums[slab] + new, least) if slab in sums else new
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(v >= least, bitorder="little").tobytes() for v in sums.values()], pa.binary())], names=["slab", "bits"])

    out = np.zeros((buckets // width, width // 8), np.uint8)
    dealt = counts.filter("slab is not null").select("slab", "counts").repartition(min(256, len(out)), "slab")
    for r in dealt.mapInArrow(add, "slab int, bits binary").collect():  # buckets / 8 bytes
        out[r.slab] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _bitmap(frequent: DataFrame, buckets: int) -> np.ndarray:
    """The bitmap of the phrases' hashes."""
    at = F.col("hash").bitwiseAND(F.lit(buckets - 1)) + 1
    out = np.zeros(max(buckets // 8, _SLAB // 8), np.uint8).reshape(-1, _SLAB // 8)
    for r in frequent.select(F.bitmap_bucket_number(at).alias("slab"), F.bitmap_bit_position(at).alias("bit")).groupBy("slab").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[r.slab - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(-1)[: buckets // 8]


def _buckets(docs: DataFrame, text: Column, most: int) -> int:
    """A bucket for about 32 bytes of text, a power of two from 2**15 to ``most``."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(most, 1 << max(15, math.ceil(math.log2(size / 32 + 1))))


def frequent_phrases(texts: DataFrame, least: int, longest: int, buckets: int) -> DataFrame:
    """``lang, phrase, size, n``: all words with their counts, and all phrases of up to ``longest`` words that stand ``least`` times.

    ``texts(lang, text)`` are without nulls.
    """
    found, maps = None, []
    for size in range(1, longest + 1):
        with _bounded_batches(texts.sparkSession):
            counts = materialise(_pass(texts, size, longest, least, buckets, maps))
        sums = counts.filter("slab is null").groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("n"))
        sums = materialise(sums if size == 1 else sums.filter(F.col("n") >= least))
        rows = sums.select("lang", "phrase", F.lit(size).alias("size"), "n")
        found = rows if found is None else found.union(rows)
        if size < longest:
            maps.append((_bitmap(sums.filter(F.col("n") >= least), buckets), _full_buckets(counts, least, buckets)))
    return found


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, absorb: int = 100, most_buckets: int = 1 << 26, shard_rows: int = 1_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two to ``longest`` words.

    Texts, lower-cased A-Z (null: empty), are split at ``.,;:!?`` and line breaks into pieces and
    those at blanks and tabs into words; a null language is ``und``, together with that
    name. ``n`` counts a language's words, ``a`` the occurrences of the phrase inside
    pieces, overlaps included; phrases below ``least`` aren't taken. Cut into two parts that
    stand ``l`` and ``r`` times a phrase scores floor(1000 * a * n / (l * r)), in decimals of 38
    digits; the cut with the lowest score counts, the earliest of equal ones. A phrase goes
    if a longer one that holds it has ``absorb`` hundredths of its occurrences or more,
    whether or not that goes itself (one that is longer by one word then has, too). Ties go
    to more occurrences, then to the smaller phrase by bytes. Repeated rows count as often
    as they stand. No rows, or none with a phrase, give no rows; other columns are ignored.

    A task holds a block of texts and a count a bucket; there are at most ``most_buckets``, so
    that a bitmap has at most 8 MB. With more phrases than buckets the bitmaps prune less
    and the results are the same.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    counts = frequent_phrases(texts, least, longest, _buckets(docs, text, most_buckets))
    sizes = counts.filter("size = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    counts = materialise(counts.filter(F.col("n") >= least))

    parts = F.split("phrase", " ", -1)
    longer = counts.filter("size > 2")
    inner = [F.array_join(F.slice(parts, first, F.col("size") - 1), " ") for first in (1, 2)]
    held = longer.select("lang", F.explode(F.array(*inner)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("outer"))
    whole = sized_join(counts.filter("size > 1"), held, ["lang", "phrase"], "left")
    kept = whole.filter(F.coalesce(100 * F.col("outer") < absorb * F.col("n"), F.lit(True))).drop("outer")
    kept = materialise(sized_join(kept, sizes, ["lang"], "inner"))

    cut = kept.select("lang", "phrase", F.col("n").alias("a"), F.col("total").alias("n"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cut = cut.select("*", F.array_join(F.slice(parts, F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice(parts, F.col("cut") + 1, F.col("size")), " ").alias("right"))
    known = counts.select("lang", "phrase", F.col("n").alias("count"))
    cut = sized_join(cut, known.select("lang", F.col("phrase").alias("left"), F.col("count").alias("l")), ["lang", "left"], "inner")
    cut = sized_join(cut, known.select("lang", F.col("phrase").alias("right"), F.col("count").alias("r")), ["lang", "right"], "inner")
    exact = "cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    scored = cut.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")

    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    shards = math.ceil(kept.count() / shard_rows)
    if shards > 1:  # no more than ``top`` of a shard can be among the first of all
        dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shards))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(dealt)).filter(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
