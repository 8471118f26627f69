"""Ranks, latest rows, islands and running positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import keyed_value


def top_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` of each group; ``order`` must end in a unique key."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(over)).filter(F.col(rank) <= n)


def latest(rows: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    return top_n(rows, keys, [F.col(time).desc(), F.col(tie).desc()], 1).drop("rank")


def preferred(history: DataFrame, kind: str, part: str, score: str, least: int = 3, n: int = 2, current: DataFrame | None = None) -> DataFrame:
    """The ``n`` parts of best mean score for each kind with ``least`` observations; ties by name.

    Kinds are trimmed and lower-cased, observations without a part don't count, nor do
    the kinds' parts in ``current``, which are to be replaced.
    """
    kept = history.filter(F.col(part).isNotNull()).withColumn(kind, F.trim(F.lower(F.col(kind))))
    per = kept.groupBy(kind, part).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n_obs"))
    over = Window.partitionBy(kind)
    enough = per.withColumn("n_kind", F.sum("n_obs").over(over)).filter(F.col("n_kind") >= least)
    if current is not None:
        enough = enough.join(current.select(F.trim(F.lower(F.col(kind))).alias(kind), part).distinct(), [kind, part], "left_anti")
    return top_n(enough, [kind], [F.round("mean_score", 9).desc(), F.col(part)], n)


#: Reference prefixes, exact names first, then the first name contained.
PREFIXES = {
    "capacitor": "C", "cap": "C", "resistor": "R", "res": "R", "inductor": "L", "ind": "L", "antenna": "ANT", "ant": "ANT", "connector": "J", "conn": "J", "crystal": "X", "xtal": "X", "diode": "D",
    "transistor": "Q", "fuse": "F", "switch": "SW", "led": "D", "battery": "BT", "speaker": "SP", "microphone": "MK", "transformer": "T", "relay": "K", "motor": "M", "solenoid": "SOL",
    "potentiometer": "RV", "varistor": "RV", "thermistor": "RT",
}


def designators(bom: DataFrame, design: str = "design_id", kind: str = "component_type", pos: str = "pos") -> DataFrame:
    """``ref``: prefix of the type and a counter for each prefix, in input order."""
    prefix = keyed_value(F.col(kind), PREFIXES, "U")
    number = F.row_number().over(Window.partitionBy(design, "_p").orderBy(pos))
    return bom.withColumn("_p", prefix).withColumn("ref", F.concat("_p", number)).drop("_p")


def islands(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Runs of equal values: keys, run number, value, first and last position and length."""
    over = Window.partitionBy(*keys).orderBy(order)
    begun = rows.withColumn("_new", F.when(F.col(value).eqNullSafe(F.lag(value).over(over)) & (F.row_number().over(over) > 1), 0).otherwise(1))
    numbered = begun.withColumn("run", F.sum("_new").over(over))
    return numbered.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def merged_cells(cells: DataFrame) -> DataFrame:
    """Column spans of ``grid_id, row, col, text``: runs of the same non-empty text in a row."""
    runs = islands(cells, ["grid_id", "row"], "col", "text")
    return runs.select("grid_id", "row", F.col("first").alias("col"), "text", F.when(F.length("text") > 0, F.col("length")).otherwise(1).alias("colspan"))


def merged_rows(cells: DataFrame) -> DataFrame:
    """Row spans of ``grid_id, row, col, text``: runs of the same non-empty text in a column."""
    runs = islands(cells, ["grid_id", "col"], "row", "text")
    return runs.select("grid_id", F.col("first").alias("row"), "col", "text", F.when(F.length("text") > 0, F.col("length")).otherwise(1).alias("rowspan"))


def continuations(tables: DataFrame, least: float = 0.8) -> DataFrame:
    """Whether a table continues the last one that isn't itself a continuation, on a following page, with a like header.

    ``tables(doc_id, page, pos, n_cols, header array<string>)``. The decision needs the
    decisions before it, so a document is one pandas frame.
    """
    import pandas as pd

    def walk(doc: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values(["page", "pos"])
        base, page, flags = None, None, []
        for row in doc.itertuples():
            same = False
            if base is not None and row.n_cols == base.n_cols and row.page == page + 1:
                a, b = set(row.header), set(base.header)
                same = not a or (len(a & b) / max(len(a | b), 1)) >= least
            flags.append(same)
            base, page = (base if same else row), row.page
        return doc[["doc_id", "page", "pos"]].assign(is_continuation=flags)

    return tables.groupBy("doc_id").applyInPandas(walk, "doc_id long, page int, pos int, is_continuation boolean")


def positions(rows: DataFrame, design: str, group: str, order: str, step: float = 5.0) -> DataFrame:
    """x of every component: its place in its group, after all earlier groups and a gap of two steps for each."""
    sizes = rows.groupBy(design, group).agg(F.count("*").alias("n"))
    before = F.sum((F.col("n") + 2) * step).over(Window.partitionBy(design).orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(design, group, F.coalesce(before, F.lit(0.0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(design, group).orderBy(order)) - 1
    return rows.withColumn("_i", place).join(offsets, [design, group]).withColumn("x", F.col("_i") * step + F.col("_o")).drop("_i", "_o")


def wires(pins: DataFrame, design: str, net: str, order: str, pin: str) -> DataFrame:
    """Segments between consecutive pins of a net."""
    over = Window.partitionBy(design, net).orderBy(order)
    return pins.select(design, net, F.col(pin).alias("from_pin"), F.lead(pin).over(over).alias("to_pin")).filter("to_pin IS NOT NULL")


def ladder(entries: DataFrame, keys: Sequence[str], n: int = 3, factor: float = 0.97) -> DataFrame:
    """The entry and its alternatives ``alt_rank`` with confidence * factor**alt_rank, the ``n`` best."""
    scored = entries.withColumn("variant_confidence", F.round(F.col("confidence") * F.pow(F.lit(factor), F.col("alt_rank")), 4))
    return top_n(scored, keys, [F.col("variant_confidence").desc(), F.col("alt_rank")], n)


def enriched_ladder(entries: DataFrame, preferred_parts: DataFrame, keys: Sequence[str], kind: str, n: int = 3, factor: float = 0.97) -> DataFrame:
    """Ladders whose alternatives are the preferred parts of the entry's type: the entry's own part first, then those by rank, each with the factor once more.

    ``preferred_parts(kind, part, rank)``; an entry's own part isn't its alternative.
    """
    own = entries.select(*keys, kind, "part", "confidence", F.lit(0).alias("alt_rank"))
    other = entries.select(*keys, kind, F.col("part").alias("_own"), "confidence").join(preferred_parts.select(kind, "part", F.col("rank").cast("int").alias("alt_rank")), kind).filter(~F.col("part").eqNullSafe(F.col("_own"))).drop("_own")
    return ladder(own.unionByName(other), keys, n, factor)


def better_of(a: DataFrame, b: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Of two extractions of a key the one with the higher score; the first on ties."""
    both = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(0)))
    return top_n(both, keys, [F.col(score).desc_nulls_last(), F.col("_s").desc()], 1).drop("rank", "_s")


def sessions(events: DataFrame, user: str, time: str, gap_seconds: int) -> DataFrame:
    """Session numbers (an extension): a new one after more than ``gap_seconds`` without events."""
    over = Window.partitionBy(user).orderBy(time)
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    apart = seconds(F.col(time)) - seconds(F.lag(time).over(over))
    return events.withColumn("session", F.sum(F.when(apart <= gap_seconds, 0).otherwise(1)).over(over))
