"""Mixing sources to target weights by fitting a subset of each source's documents to its budget.

Documents are counted by source and exact length. A source whose target is more than its
own size is taken whole as often as that fits; the rest is a subset-sum problem over its
histogram of lengths. Most of the rest is taken from every length in proportion, so that
the mix keeps the source's lengths, and a bounded-knapsack dynamic programme over the
lengths that are left finds the sum nearest to what then remains. Documents of a length
are interchangeable to it: which of them go into the mix is decided by a seeded hash.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sized_join
from .packing import count_words


def targets(sizes: list[int], weights: list[int], total: Fraction, most: int) -> list[Fraction]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is above goes to the others by weight."""
    out, left, weight = [Fraction(0)] * len(sizes), Fraction(total), sum(weights)
    for i in sorted(range(len(sizes)), key=lambda i: (Fraction(sizes[i], weights[i]), i)):  # those that reach their bound first
        out[i] = min(Fraction(most * sizes[i]), left * weights[i] / weight)
        left, weight = left - out[i], weight - weights[i]
    return out


def _knapsack(lengths: list[int], counts: list[int], goal: int, top: int) -> tuple[int, list[int]]:
    """The sum nearest to ``goal`` and below ``top`` (of two as near the smaller), and how many of each length make it.

    A count is split into powers of two, so that a length costs the logarithm of its count.
    A sum remembers the piece that reached it first; the pieces before reached what is left.
    """
    found, piece = np.zeros(top, bool), np.full(top, -1, np.int32)
    found[0] = True
    pieces: list[tuple[int, int]] = []  # position of the length, how many
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        count, step = min(count, (top - 1) // length), 1
        while count and not found[goal]:
            step = min(step, count)
            size = length * step
            new = np.flatnonzero(found[:-size] & ~found[size:]) + size
            found[new], piece[new] = True, len(pieces)
            pieces.append((i, step))
            count, step = count - step, 2 * step
    sums = np.flatnonzero(found)
    best = at = int(sums[np.argmin(np.abs(sums - goal))])
    taken = [0] * len(lengths)
    while at:
        i, step = pieces[piece[at]]
        taken[i] += step
        at -= lengths[i] * step
    return best, taken


def fit(lengths: list[int], counts: list[int], rest: int, sums: int = 1 << 22) -> list[int]:
    """How many documents of each length to take so that their words come as near to ``rest`` as can be found.

    ``rest`` is less than all words together. Every length gives its share of ``rest``,
    rounded down; then the longest give more until less than twice the largest length is
    missing, for which the dynamic programme sums up. If no sum meets ``rest``, half of what
    was taken before goes back and the programme runs again, until a sum meets it, it ran
    over all documents, or its table would hold more than ``sums`` sums.
    """
    if not rest:
        return [0] * len(lengths)
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    total, largest = sum(lengths[i] * counts[i] for i in order), lengths[order[0]]
    taken = [counts[i] * rest // total if lengths[i] else 0 for i in range(len(lengths))]
    left = rest - sum(n * m for n, m in zip(lengths, taken, strict=True))
    for i in order:
        more = max(0, min(counts[i] - taken[i], (left - largest) // lengths[i]))
        taken[i], left = taken[i] + more, left - more * lengths[i]
    best = None
    while True:
        found, extra = _knapsack([lengths[i] for i in order], [counts[i] - taken[i] for i in order], left, left + largest + 1)
        off = abs(found - left)
        if best is None or off < best[0]:
            best = off, [t + e for t, e in zip(taken, _spread(extra, order, len(lengths)), strict=True)]
        if not off or not any(taken):
            return best[1]
        taken = [n // 2 for n in taken]
        left = rest - sum(n * m for n, m in zip(lengths, taken, strict=True))
        if left + largest >= sums:
            return best[1]


def _spread(values: list[int], order: list[int], size: int) -> list[int]:
    out = [0] * size
    for i, v in zip(order, values, strict=True):
        out[i] = v
    return out


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 11, shard_rows: int = 100_000, sums: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every document.

    ``size`` is the number of words (null text: 0). Sources in code-point order, null
    last, weigh ``weights``, repeated; they share ``share`` of all words, none more than
    ``most`` times its own, the excess shared by the others. ``copies`` is how often the
    mix takes the document, ``taken`` its words in the mix. The words taken of a source
    are the nearest sum that `fit` found to its target, rounded half up. A document is
    taken as often as the whole source fits into its target, or once more; documents
    of no words are taken as often as the whole source. Which documents of a length go once
    more is decided by a hash of seed, id and text, and between rows alike in both, freely.
    A null id is an id like others. No rows give no rows; other columns are ignored.

    The driver sees a row a source. A source's histogram, a row a length, is fitted in a task;
    ranks are taken inside shards of about ``shard_rows`` rows of a source and length, so
    none is sorted in one task.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(source_col).isNotNull().alias("named"), count_words(F.col(text_col)).alias("size"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1).alias("hash"))
    rows = materialise(rows)
    key = ["source", "named"]
    counted = materialise(rows.groupBy(*key, "size").agg(F.count("*").alias("n")))
    found = counted.groupBy(*key).agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    found = sorted(found, key=lambda r: (not r.named, r.source))
    sizes = [r.words for r in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    budgets = []
    for r, aim in zip(found, aims, strict=True):
        goal = math.floor(aim + Fraction(1, 2))
        budgets.append((r.source, r.named, r.words, float(aim), goal // r.words if r.words else 0, goal % r.words if r.words else 0))
    budget = rows.sparkSession.createDataFrame(budgets, "source string, named boolean, source_size long, target double, whole long, rest long")

    def fitted(hist: pd.DataFrame) -> pd.DataFrame:
        hist = hist.sort_values("size", ignore_index=True)
        more = fit(hist["size"].tolist(), hist["n"].tolist(), int(hist["rest"].iloc[0]), sums)
        return hist.assign(more=more)[["source", "named", "size", "n", "source_size", "target", "whole", "more"]]

    plan = counted.join(F.broadcast(budget), key).groupBy(*key).applyInPandas(fitted, "source string, named boolean, size long, n long, source_size long, target double, whole long, more long")
    plan = materialise(plan.withColumn("shards", F.ceil(F.col("n") / shard_rows)).drop("n"))

    # 31 bits of the hash, in order, dealt to a length's shards: shards ascend with the hash
    shard = F.shiftright(F.shiftright("hash", 32) * F.col("shards"), 31)
    dealt = sized_join(rows, plan, [*key, "size"], "inner").withColumn("shard", shard)
    place = [*key, "size", "shard"]
    before = F.sum("n").over(Window.partitionBy(*key, "size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    split = dealt.filter("shards > 1").groupBy(*place).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("hash", "doc_id"))
    first = sized_join(dealt, split, place, "left")
    ranked = first.withColumn("copies", F.col("whole") + (F.coalesce("before", F.lit(0)) + rank <= F.col("more")).cast("long"))
    return ranked.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
