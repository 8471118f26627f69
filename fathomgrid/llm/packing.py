"""Packing documents into token-budget batches of optimal length buckets.

A dynamic programme over the global histogram of lengths chooses the bucket
boundaries with the least padding; inside a bucket, where every sequence is padded to
the boundary, batches of as many sequences as the token budget allows are formed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` boundaries that minimise padding; ``lengths`` ascend, the last is a boundary.

    ``best[j]`` is the least padding of the first j lengths; with one more bucket that
    ends at length j and begins after length i it is best[i] + length_j * (rows between)
    - (tokens between). The best i never falls as j grows, so the i of the middle j
    halves the search for the others. Ties go to the fewest and smallest boundaries.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    tokens = np.concatenate([[0], np.cumsum(lengths * counts)]).astype(float)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back = np.zeros((min(buckets, n) + 1, n + 1), int)
    results = []
    for b in range(1, min(buckets, n) + 1):
        new = np.full(n + 1, np.inf)
        spans = [(b, n, b - 1, n - 1)]  # lengths whose i is sought, and where it lies
        while spans:
            low, high, first, last = spans.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
            at = int(i[np.argmin(cost)])
            back[b, j], new[j] = at, cost.min()
            spans += [(low, j - 1, first, at), (j + 1, high, at, last)]
        best = new
        results.append(best[n])
    b, j, out = int(np.argmin(results)) + 1, n, []
    while b:
        out.append(int(lengths[j - 1]))
        b, j = b - 1, int(back[b, j])
    return out[::-1]


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pack(docs: DataFrame, max_len: int = 2048, budget: int = 16_384, buckets: int = 16, tokens: Column | None = None, shard_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, bucket, batch, slot, n_slots.

    ``tokens`` is a column of lengths (by default the number of words of the text; null
    is 0). A document longer than ``max_len`` is cut into pieces of ``max_len`` tokens and
    a rest; an empty or null one is one piece of no tokens. ``bucket`` is the length a
    piece is padded to. ``batch`` numbers the batches of a bucket from 0 and ``slot`` the
    pieces of a batch; every batch but a bucket's last has n_slots = budget // bucket
    pieces, one at least. Rows that are alike are kept apart; their order is free.
    Null ids are kept. No rows give no rows; other columns are ignored.

    The histogram has at most max_len + 1 rows. Ranks inside a bucket come from counts
    of shards of about ``shard_rows`` rows, so no bucket is sorted in one task.
    """
    n = F.coalesce(tokens if tokens is not None else count_words(F.col(text_col)), F.lit(0)).cast("long")
    whole = docs.select(F.col(id_col).alias("doc_id"), n.alias("n"), F.monotonically_increasing_id().alias("row"))
    last = F.greatest(F.ceil(F.col("n") / max_len) - 1, F.lit(0)).cast("int")
    pieces = whole.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("long") * max_len
    pieces = materialise(pieces.select("doc_id", "row", "piece", first.alias("first_token"), F.least(F.col("n") - first, F.lit(max_len)).cast("int").alias("n_tokens")))

    found = pieces.groupBy("n_tokens").agg(F.count("*").alias("rows")).orderBy("n_tokens").collect()
    lengths, counts = np.array([r.n_tokens for r in found]), np.array([r.rows for r in found])
    ends = boundaries(lengths, counts, buckets)
    shards = max(1, math.ceil(int(counts.sum()) / shard_rows)) if found else 1
    bucket = F.coalesce(*(F.when(F.col("n_tokens") <= end, F.lit(end)) for end in ends)) if ends else F.lit(0)
    dealt = pieces.withColumns({"bucket": bucket.cast("int"), "shard": F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int")})
    sizes = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("bucket").alias("b"), F.col("shard").alias("s"), F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("row", "piece")) - 1
    ranked = dealt.withColumn("own", own).join(offsets, (F.col("bucket") == F.col("b")) & (F.col("shard") == F.col("s")))
    rank, slots = F.col("own") + F.col("before"), F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1))), F.lit(1))
    return ranked.select("doc_id", "piece", "first_token", "n_tokens", "bucket", F.floor(rank / slots).cast("long").alias("batch"), F.pmod(rank, slots).cast("int").alias("slot"), slots.cast("int").alias("n_slots"))
