"""Stupid-backoff scores of documents, computed relationally.

A document is scored by the n-grams of all other rows: of every count the document's
own occurrences are taken off, as a model that holds the text itself would call any
text certain. A word scores c(v w) / c(v) for the longest n-gram that other rows hold,
times ``alpha`` for each word by which the context was shortened; with no context left
c(w) / N, and a word that nothing else holds ``alpha`` / N more.

Texts are dealt to blocks by their hash. A block sends each of its distinct n-grams of all
orders once, sorted and packed, to the range of hashes that it lies in; a range adds up
the counts of all blocks and sends each block how often the others hold its n-grams, in
the block's own order and so without the n-grams. The block, joined to what came back,
takes off each text's own occurrences and sums logarithms.

A frequent n-gram is one entry for each block, whatever its count, so that none piles up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, sized_join

_START = xxhash.xxh64_intdigest(b"\n")  # what stands before the first word; no word holds white space


class Hasher(dict):
    """Word -> hash, cleared when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def words(self, text: str | None, order: int) -> np.ndarray:
        """The words of a text after ``order - 1`` start marks; empty without words."""
        split = text.encode().lower().split() if text else []
        size = len(split) + order - 1
        return np.fromiter(chain([_START] * (order - 1), map(self.__getitem__, split)), np.uint64, size) if split else np.array([], np.uint64)


def _longer(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that end at each word but the first, one word longer than ``grams``."""
    h = (grams[:-1] ^ (grams[:-1] >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + words[-len(grams) + 1 :]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _orders(words: np.ndarray, order: int) -> list[np.ndarray]:
    """N-grams of every order; those of order k end at word k and all later ones."""
    out = [words]
    for _ in range(order - 1):
        out.append(_longer(out[-1], words))
    return out


_TWO_BITS = np.array([0, 2, 4, 6], np.uint8)


def pack_grams(grams: np.ndarray) -> bytes:
    """Sorted distinct hashes: how many low bytes stand as they are, the first hash, those bytes, two bits more of each, and the steps of the rest in unary, a bit of 1 for each hash."""
    for low in (5, 6, 7):
        high = (grams >> np.uint64(8 * low + 2)).astype(np.int64)
        if high[-1] - high[0] <= 8 * len(grams):
            break
    more = np.zeros(-len(grams) % 4 + len(grams), np.uint8)
    more[: len(grams)] = (grams >> np.uint64(8 * low)).astype(np.uint8) & 3
    steps = np.zeros(int(high[-1] - high[0]) + len(grams), bool)
    steps[high - high[0] + np.arange(len(grams))] = True
    return bytes([low]) + grams[:1].tobytes() + grams.view(np.uint8).reshape(-1, 8)[:, :low].tobytes() + np.bitwise_or.reduce(more.reshape(-1, 4) << _TWO_BITS, axis=1).tobytes() + np.packbits(steps).tobytes()


def unpack_grams(packed: bytes, size: int) -> np.ndarray:
    low, first, quarter = packed[0], np.frombuffer(packed, np.uint64, 1, 1)[0], -(-size // 4)
    out = np.zeros((size, 8), np.uint8)
    out[:, :low] = np.frombuffer(packed, np.uint8, low * size, 9).reshape(-1, low)
    out = out.reshape(-1).view(np.uint64)
    more = (np.frombuffer(packed, np.uint8, quarter, 9 + low * size)[:, None] >> _TWO_BITS & 3).reshape(-1)[:size]
    high = np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, -1, 9 + low * size + quarter)))[:size] - np.arange(size)
    return out + (more.astype(np.uint64) << np.uint64(8 * low)) + ((high.astype(np.uint64) + (first >> np.uint64(8 * low + 2))) << np.uint64(8 * low + 2))


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts by byte, compressed: most are small."""
    planes = np.ascontiguousarray(counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack_counts(packed: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * size, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(np.int64)


def _first(ordered: np.ndarray) -> np.ndarray:
    """Whether each of the sorted values is the first of its kind."""
    return np.concatenate((np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]))


class _Block:
    """The texts of a block, each once: their n-grams of all orders one after the other, by order, then text, then place."""

    def __init__(self, rows: pa.Table, order: int) -> None:
        hasher, parts, self.docs, self.copies, self.sizes = Hasher(), [[] for _ in range(order)], [], [], []
        seen = set()
        for doc, copies, text in zip(rows["doc"].to_pylist(), rows["copies"].to_pylist(), rows["text"].to_pylist(), strict=True):
            if doc in seen:
                continue
            seen.add(doc)
            words = hasher.words(text, order)
            if len(words):
                self.docs.append(doc)
                self.copies.append(copies)
                self.sizes.append(len(words) - order + 1)
                for k, grams in enumerate(_orders(words, order), 1):
                    parts[k - 1].append(grams[max(order - 1 - k, 0) :])  # from the last that is all start marks
        #: of each order, how many n-grams a text has beside those that end at its words
        self.marks = [int(k < order) for k in range(1, order + 1)]
        self.grams = np.concatenate([g for p in parts for g in p]) if self.docs else np.array([], np.uint64)
        self.of = np.concatenate([np.repeat(np.arange(len(self.docs), dtype=np.int32), np.array(self.sizes, np.int64) + m) for m in self.marks]) if self.docs else np.array([], np.int32)


def _send(order: int, ranges: int):
    """Of each block: ``part``, the range of hashes, ``block``, the sorted n-grams in it and their counts, copies counted."""

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        block = _Block(rows, order)
        at = np.argsort(block.grams, kind="stable")
        ordered = block.grams[at]
        first = np.flatnonzero(_first(ordered))
        counts = np.add.reduceat(np.array(block.copies, np.int64)[block.of[at]], first) if len(at) else at
        grams = ordered[first]
        del at, ordered, block
        part = _range(grams, ranges)
        starts = np.flatnonzero(_first(part))
        cuts = list(zip(starts, [*starts[1:], len(grams)], strict=True)) if len(grams) else []
        return pa.table(
            {
                "part": pa.array([int(part[a]) for a, _ in cuts], pa.int32()),
                "block": pa.array([key[0].as_py()] * len(cuts), pa.int32()),
                "size": pa.array([int(b - a) for a, b in cuts], pa.int32()),
                "grams": pa.array([pack_grams(grams[a:b]) for a, b in cuts], pa.binary()),
                "counts": pa.array([pack_counts(counts[a:b]) for a, b in cuts], pa.binary()),
            }
        )

    return send


def _range(grams: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash by its first 32 bits: they grow with it."""
    return ((grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _add_up(key: tuple, rows: pa.Table) -> pa.Table:
    """How often the n-grams of each block stand in all other blocks."""
    sizes = rows["size"].to_pylist()
    every = np.concatenate([unpack_grams(g, n) for g, n in zip(rows["grams"].to_pylist(), sizes, strict=True)])
    own = np.concatenate([unpack_counts(c, n) for c, n in zip(rows["counts"].to_pylist(), sizes, strict=True)])
    at = np.argsort(every)
    first = _first(every[at])
    total = np.add.reduceat(own[at], np.flatnonzero(first))
    others = np.empty(len(every), np.int64)
    others[at] = total[np.cumsum(first) - 1]
    others -= own
    ends = np.cumsum(sizes)
    return pa.table({"block": rows["block"], "part": rows["part"], "size": rows["size"], "others": pa.array([pack_counts(others[b - n : b]) for b, n in zip(ends, sizes, strict=True)], pa.binary())})


_SCORED = "doc long, copies long, n long, known long, last long, score double"


def _score(order: int, alpha: float):
    """Of each text of a block its score but for the words that the model's size divides, which are ``last``."""

    def score(rows: pa.Table, others: pa.Table) -> pa.Table:
        block = _Block(rows, order)
        n, left = len(block.docs), np.array(block.sizes, np.int64)
        if not n:
            return pa.table({c.split()[0]: pa.array([], pa.float64() if c.endswith("double") else pa.int64()) for c in _SCORED.split(", ")})
        copies = np.array(block.copies, np.int64)
        at = np.argsort(block.grams, kind="stable")  # n-grams, and of each its texts, in order
        first, doc = _first(block.grams[at]), block.of[at]
        runs = np.flatnonzero(first | _first(doc))
        own = np.diff(np.append(runs, len(at)))  # a text's own occurrences of each of its n-grams
        total = np.add.reduceat(copies[doc], np.flatnonzero(first)) + _of_all_ranges(others)
        del doc
        rest = np.empty(len(at), np.int64)
        rest[at] = np.maximum(total[np.cumsum(first) - 1] - np.repeat(own, own), 0)
        del at, first, runs, own, total, block.grams, block.of
        starts = np.cumsum([0] + [int(left.sum()) + m * n for m in block.marks])
        doc = np.repeat(np.arange(n), left)
        word = np.arange(len(doc)) - np.repeat(np.cumsum(left) - left, left)
        got, open_, known, last = np.zeros(n), np.ones(len(doc), bool), np.zeros(n, np.int64), np.zeros(n, np.int64)

        def of_order(k: int, back: int) -> np.ndarray:
            """What others hold of the n-grams of order ``k`` that end ``back`` words before each word."""
            m = block.marks[k - 1]
            offset = np.concatenate(([0], np.cumsum(left + m)))[:-1]
            return rest[starts[k - 1] + offset[doc] + word + m - back]

        for k in range(order, 0, -1):
            c = of_order(k, 0)
            if k == order:
                known = np.bincount(doc[c > 0], minlength=n)
            hit = open_ & (c > 0)
            value = np.log10(c[hit]) + (order - k) * math.log10(alpha)
            if k > 1:
                value -= np.log10(np.maximum(of_order(k - 1, 1)[hit], 1))
            got += np.bincount(doc[hit], value, n)
            if k == 1:
                last = np.bincount(doc[open_], minlength=n)
            open_ &= ~hit
        got += np.bincount(doc[open_], minlength=n) * order * math.log10(alpha)
        return pa.table({"doc": pa.array(block.docs, pa.int64()), "copies": pa.array(copies), "n": pa.array(left), "known": pa.array(known.astype(np.int64)), "last": pa.array(last.astype(np.int64)), "score": pa.array(got)})

    return score


def _of_all_ranges(others: pa.Table) -> np.ndarray:
    """The counts of all ranges, in the order of the hashes."""
    rows = sorted(zip(*(others[c].to_pylist() for c in ("part", "size", "others")), strict=True))
    return np.concatenate([unpack_counts(packed, size) for _, size, packed in rows])


def _distinct_texts(keyed: DataFrame) -> DataFrame:
    """``doc, copies, text`` with one row for each text, but for rows alike in id and text, of which any stands for all."""
    plain = keyed.filter(F.octet_length("text") > 0).select("doc", F.coalesce("doc_id", F.lit(0)).alias("id"), "text")
    copies = plain.groupBy("doc").agg(F.count("*").alias("copies"), F.min("id").alias("kept")).filter("copies > 1")
    return sized_join(plain, materialise(copies), ["doc"], "left").filter("kept IS NULL OR id = kept").select("doc", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "text")


def _log(x: Column) -> Column:
    return F.log10(F.greatest(x.cast("double"), F.lit(1.0)))


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, share: int = 65_536, block_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_known, log10_score, mean_log10.

    Words are split at ASCII white space, A-Z lower-cased, and follow ``order`` - 1 start
    marks. n_known counts the words whose whole n-gram another row holds; log10_score
    is the sum over words, mean_log10 that by n_words (null without words, as for null
    and empty texts). Every row counts for the tables, repeated ones too: a row that
    stands twice is known from its copy. Null ids are kept; rows of the same text get
    the same score. No rows give no rows; other columns are ignored. A block holds about
    ``block_bytes`` bytes of text, a range of hashes the n-grams of as many. ``share``
    changes nothing: no n-gram is frequent enough to need another way.
    """
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("doc"), text.alias("text"))
    octets = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(octets / 1_000_000))
    blocks = max(1, spread, math.ceil(octets / block_bytes))
    dealt = _distinct_texts(keyed).withColumn("block", F.pmod("doc", F.lit(blocks)).cast("int")).repartition(blocks, "block")
    sent = dealt.groupBy("block").applyInArrow(_send(order, blocks), "part int, block int, size int, grams binary, counts binary")
    others = sent.repartition(blocks, "part").groupBy("part").applyInArrow(_add_up, "block int, part int, size int, others binary")
    scored = materialise(dealt.groupBy("block").cogroup(others.repartition(blocks, "block").groupBy("block")).applyInArrow(_score(order, alpha), _SCORED))
    words = scored.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] or 0
    zero = F.lit(0).cast("long")
    of_doc = scored.select(F.col("doc").alias("of"), "known", "n", (F.col("score") - F.col("last") * _log(F.lit(words) - F.col("n"))).alias("score"))
    out = keyed.select("doc_id", "doc").join(of_doc, F.col("doc") == F.col("of"), "left")
    return out.select("doc_id", F.coalesce("n", zero).alias("n_words"), F.coalesce("known", zero).alias("n_known"), F.coalesce("score", F.lit(0.0)).alias("log10_score"), (F.col("score") / F.col("n")).alias("mean_log10"))
