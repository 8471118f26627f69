"""Line dedup by a deletion-neighbourhood join.

A line is its words (A-Z lower-cased, split at ASCII white space). Two lines are near
if one word inserted, deleted or replaced turns one into the other. Every line emits
the hashes of all variants within that bound: itself, and itself without each of its
words. Lines replaced at word i share the variant without word i; a line that lacks a
word equals a variant of the longer one. Variants are joined as hashed keys, the
words of each pair are compared, and of near lines the earliest stays. A line of one
word would be near every other, so such lines are compared for equality.

Two filters lose nothing and keep the neighbourhood small: equal lines are one, and
a line emits variants only if another line has the same first or last half, which an
edit of one word always leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOWHERE, materialise, sized_join

_B = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_B, -1, 2**64)

AT = ["owner", "text_hash", "line"]  # where a line stands; rows alike in the first two are one document


class Powers:
    """Powers of the hash's base and of its inverse modulo 2**64, as many as are asked for."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            self.up, self.down = (np.cumprod(np.array([1, *[base] * (2 * n + 64)], np.uint64), dtype=np.uint64) for base in (_B, _INVERSE))


def _prefixes(words: list[bytes], powers: Powers) -> np.ndarray:
    """Hashes of the first 0, 1, ... words: sums of word hash times base**position."""
    powers.reach(len(words) + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers.up[: len(words)], dtype=np.uint64)])


def _mix(h: np.ndarray, *salt: int | np.ndarray) -> np.ndarray:
    for s in salt:
        h = (h ^ (np.asarray(s, np.uint64) + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(29))
    return h


def halves(words: list[bytes]) -> list[int]:
    """Keys of which two near lines of two words or more share one: first and last h words, for both sizes of a half."""
    n, digest = len(words), xxhash.xxh64_intdigest
    out = []
    for h in {n // 2, (n - 1) // 2} - {0}:
        out += [digest(b" ".join(words[:h]), 11), digest(b" ".join(words[n - h :]), 12)]
    return out


def variants(words: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The line's own hash, then that without each word, and the number of that word (-1 for the line itself)."""
    p, n = _prefixes(words, powers), len(words)
    without = p[:-1] + (p[n] - p[1:]) * np.uint64(_INVERSE)
    size = np.concatenate([[n], np.full(n, n - 1)])
    return _mix(np.concatenate([p[n:], without]), size).view(np.int64), np.arange(-1, n, dtype=np.int32)


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one edit of a word at most turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _lines(docs: DataFrame, least: int, fuzzy: int) -> DataFrame:
    """Lines of ``least`` words or more: place, n, two hashes of its words, keys of its halves."""
    schema = "owner long, text_hash long, line int, n int, h1 long, h2 long, keys array<long>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            row, line, n, whole, keys, starts = [], [], [], [], [], [0]
            for i, text in enumerate(batch.column(2).to_pylist()):
                for k, body in enumerate(text.encode().lower().split(b"\n") if text else ()):
                    words = body.split()
                    size = len(words)
                    if size >= least:
                        row.append(i)
                        line.append(k)
                        n.append(size)
                        whole.append(digest(b" ".join(words)))
                        if size >= fuzzy:
                            keys += halves(words)
                        starts.append(len(keys))
            take = pa.array(row, pa.int64())
            h = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(line, pa.int32()), pa.array(n, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), lists], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("owner", "text_hash", "text").mapInArrow(split, schema)


def _neighbourhood(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """For the lines that ``asked(owner, text_hash, lines)`` names: variants, and the words with the line itself."""
    schema = "owner long, text_hash long, line int, key long, gap int, body string"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i, (text, lines) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                split = text.encode().lower().split(b"\n")
                for k in set(lines):
                    words = split[k].split()
                    key, gap = variants(words, powers)
                    size = len(key)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(batch.column(0)[i], size), pa.repeat(batch.column(1)[i], size), pa.repeat(pa.scalar(k, pa.int32()), size), pa.array(key), pa.array(gap), pa.array([b" ".join(words).decode(), *[None] * (size - 1)], pa.string())],
                        names=[x.split()[0] for x in schema.split(", ")],
                    )

    return sized_join(docs, asked, ["owner", "text_hash"], "inner").select("owner", "text_hash", "text", "lines").mapInArrow(emit, schema)


def _near(variant: DataFrame, share: int = 4096) -> DataFrame:
    """Pairs ``later, earlier`` of places of near lines; every line with an earlier near line is in one.

    Lines that share a gap's variant are compared with the earliest of them only. Keys
    that make up one in ``share`` of all, as of a template line in which one word
    changes, are joined by broadcast.
    """
    place = F.struct(*AT)
    gaps = variant.filter("gap >= 0").select(place.alias("place"), "key", "gap")
    whole = variant.filter("gap < 0").select(place.alias("one"), F.col("key").alias("same"))
    first = materialise(gaps.groupBy(F.col("key").alias("k"), F.col("gap").alias("g")).agg(F.min("place").alias("one"), F.count("*").alias("n")).filter("n > 1"))
    least = max(1000.0, (first.agg(F.sum("n")).first()[0] or 0) / share)
    hot = F.broadcast(first.filter(F.col("n") >= least).select(F.col("k").alias("hot")).distinct())  # no more than ``share``
    often = gaps.join(hot, F.col("key") == F.col("hot"), "left_semi")
    rest = gaps.join(hot, F.col("key") == F.col("hot"), "left_anti")
    pairs = []
    for rows, one, same in ((rest, first, whole), (often, F.broadcast(first.join(hot, F.col("k") == F.col("hot"), "left_semi")), F.broadcast(whole.join(hot, F.col("same") == F.col("hot"), "left_semi")))):
        replaced = rows.join(one.drop("n"), (F.col("key") == F.col("k")) & (F.col("gap") == F.col("g"))).filter("place <> one")
        missing = rows.join(same, F.col("key") == F.col("same")).filter("place <> one")
        pairs += [replaced.select("place", "one"), missing.select("place", "one")]
    pairs = pairs[0].union(pairs[1]).union(pairs[2]).union(pairs[3])
    return pairs.select(F.greatest("place", "one").alias("later"), F.least("place", "one").alias("earlier")).distinct()


def near_lines(docs: DataFrame, lines: DataFrame, fuzzy: int) -> DataFrame:
    """Places of distinct lines (their first ones) that have an earlier near line."""
    distinct = materialise(lines.filter(F.col("n") >= fuzzy).groupBy("h1", "h2").agg(F.min(F.struct(*AT)).alias("place"), F.first("keys").alias("keys")))
    keys = distinct.select("place", F.explode("keys").alias("key"))
    common = keys.groupBy(F.col("key").alias("shared")).agg(F.count("*").alias("n")).filter("n > 1")
    asked = keys.join(common, F.col("key") == F.col("shared"), "left_semi").select("place.*").distinct().groupBy("owner", "text_hash").agg(F.collect_set("line").alias("lines"))
    variant = materialise(_neighbourhood(docs, materialise(asked)))
    bodies = variant.filter("gap < 0").select(F.struct(*AT).alias("at"), "body")
    pairs = _near(variant)
    pairs = pairs.join(bodies.withColumnsRenamed({"at": "at1", "body": "body1"}), F.col("later") == F.col("at1"))
    pairs = pairs.join(bodies.withColumnsRenamed({"at": "at2", "body": "body2"}), F.col("earlier") == F.col("at2"))

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype="bool")

    return pairs.filter(verified("body1", "body2")).select("later.*").distinct()


def _rewrite(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines in the array column ``__fg_drop`` taken out of ``__fg_text``."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, drops: pd.Series) -> pd.Series:
        def cut(text, drop):
            gone = set(drop)
            return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

        return pd.Series([None if t is None else cut(t, d) for t, d in zip(texts, drops, strict=True)], dtype="object")

    many = F.size("__fg_drop") > 64  # a look-up in the array for each line would take too long; other rows send Python a null
    few = F.array_join(F.filter(F.split("__fg_text", "\n"), lambda x, i: ~F.array_contains("__fg_drop", i)), "\n")
    return docs.withColumn("__fg_kept", F.when(F.col("__fg_drop").isNull(), F.col("__fg_text")).when(many, without(F.when(many, F.col("__fg_text")), F.when(many, F.col("__fg_drop")))).otherwise(few))


def dedup_lines(docs: DataFrame, counts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated and near lines taken out of the texts.

    A line goes if an equal or a near line stands earlier: in a row of smaller id or, in
    the same text, further up. Near lines have two words or more each; lines of one word
    are compared for equality, blank lines stay. Null ids come last; rows that share an
    id are ordered by a hash of the text, and rows alike in id and text are one document:
    they get the same result. Null texts stay null, a document whose lines all go is left
    with an empty text. Every row and column of ``docs`` is kept. No rows give no rows.

    With ``counts`` the columns are instead the id, the text, n_lines, n_dropped and n_near.
    """
    least, fuzzy = 1, 2  # words of a line that is compared, and of one that can be near
    keyed = docs.withColumns({"__fg_owner": F.coalesce(F.col(id_col).cast("long"), F.lit(NOWHERE)), "__fg_text": F.col(text_col)}).withColumn("__fg_hash", F.xxhash64("__fg_text"))
    plain = keyed.select(F.col("__fg_owner").alias("owner"), F.col("__fg_hash").alias("text_hash"), F.col("__fg_text").alias("text"))
    lines = materialise(_lines(plain, least, fuzzy))
    near = materialise(near_lines(plain, lines, fuzzy))
    first = lines.groupBy("h1", "h2").agg(F.min(F.struct(*AT)).alias("place"), F.max(F.struct(*AT)).alias("last"))
    marked = first.join(near.select(F.struct(*AT).alias("place"), F.lit(True).alias("near")), "place", "left")
    bad = materialise(marked.filter(F.col("near") | (F.col("place") != F.col("last"))).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "place", F.coalesce("near", F.lit(False)).alias("near")))
    gone = lines.join(bad, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).filter(F.col("near") | (F.struct(*AT) != F.col("place")))
    drops = gone.groupBy(F.col("owner").alias("__fg_owner"), F.col("text_hash").alias("__fg_hash")).agg(F.collect_set("line").alias("__fg_drop"), F.count_if("near").alias("__fg_near"))
    joined = sized_join(keyed, materialise(drops), ["__fg_owner", "__fg_hash"], "left")
    done = _rewrite(joined).withColumns(
        {
            text_col: F.col("__fg_kept"),
            "__fg_lines": F.when(F.octet_length("__fg_text") > 0, F.octet_length("__fg_text") - F.octet_length(F.replace("__fg_text", F.lit("\n"), F.lit(""))) + 1).otherwise(0).cast("long"),
            "__fg_dropped": F.coalesce(F.size("__fg_drop"), F.lit(0)).cast("long"),
            "__fg_near": F.coalesce("__fg_near", F.lit(0)).cast("long"),
        }
    )
    if counts:
        return done.select(F.col(id_col), F.col(text_col), F.col("__fg_lines").alias("n_lines"), F.col("__fg_dropped").alias("n_dropped"), F.col("__fg_near").alias("n_near"))
    return done.select(*(f"`{c}`" for c in docs.columns))
