"""Joins beyond equality: bounded pairs, ranges, fallbacks, co-occurrence, motifs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def group_pairs(rows: DataFrame, group: Sequence[str], order: str, block: int = 10_000) -> DataFrame:
    """Pairs of rows of a group, ``{column}_a`` and ``{column}_b``, with ``order_a < order_b``.

    A group of more than ``block`` rows is split: its rows are dealt to blocks, and each
    block meets the whole group in a task of its own.
    """
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).filter("_blocks > 1")
    held = rows.join(sizes, list(group), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    other = [c for c in rows.columns if c not in group]
    a = held.select(*group, *(F.col(c).alias(f"{c}_a") for c in other), F.pmod(F.xxhash64(order), F.col("_blocks")).cast("int").alias("_block"))
    b = held.select(*group, *(F.col(c).alias(f"{c}_b") for c in other), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    return a.join(b, [*group, "_block"]).filter(F.col(f"{order}_a") < F.col(f"{order}_b")).drop("_block")


def apart_pairs(rows: DataFrame, group: Sequence[str], order: str, value: str, gap: float) -> DataFrame:
    """Pairs ``order_a < order_b`` of a group whose values differ by more than ``gap``; nulls pair with nothing."""
    pairs = group_pairs(rows.filter(F.col(value).isNotNull()).select(*group, order, value), group, order)
    return pairs.filter(F.abs(F.col(f"{value}_a") - F.col(f"{value}_b")) > gap)


def conflicting_groups(rows: DataFrame, group: Sequence[str], value: str, gap: float) -> DataFrame:
    """Groups that hold some pair further apart than ``gap``, from their extremes: no pairs are made."""
    return rows.groupBy(*group).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")).filter(F.col("high") - F.col("low") > gap)


def overlaps(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Whether two ranges meet; a missing end is the other end, a range without ends meets nothing."""
    la, ha, lb, hb = F.coalesce(lo_a, hi_a), F.coalesce(hi_a, lo_a), F.coalesce(lo_b, hi_b), F.coalesce(hi_b, lo_b)
    return F.coalesce((la <= hb) & (lb <= ha), F.lit(False))


def dealt_join(left: DataFrame, right: DataFrame, key: Sequence[str], block: int = 10_000) -> DataFrame:
    """Inner equi-join of which no key is one task: a key's right rows are dealt to parts of about ``block``, its left rows meet each part."""
    hot = right.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    repeated = left.join(hot, list(key), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    dealt = right.join(hot, list(key), "left").withColumn("_part", F.pmod(F.xxhash64(*right.columns), parts).cast("int")).drop("_parts")
    return repeated.join(dealt.hint("shuffle_hash"), [*key, "_part"]).drop("_part")


def member_pairs(pairs: DataFrame, members: DataFrame, on: Sequence[str], group: str, key: str, block: int = 1_000, piece: int = 64) -> DataFrame:
    """Pairs of groups, ``pairs(*on, {group}_a, {group}_b, ...)``, as pairs ``{key}_a, {key}_b`` of their ``members(*on, group, key)``, with the pair's other columns.

    Members travel in arrays: a group's are dealt to parts of about ``block`` on the right, and to pieces of about ``piece``
    on the left, each of which meets every part; rows of pairs are made last, where they are used.
    """
    side = lambda of, x: of.withColumnsRenamed({c: f"{c}_{x}" for c in of.columns if c not in on})
    sizes = members.groupBy(*on, group).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"), F.ceil(F.count("*") / piece).cast("int").alias("_pieces"))
    dealt = lambda into: members.join(sizes, [*on, group]).groupBy(*on, group, F.pmod(F.xxhash64(key), F.col(into)).cast("int").alias("_part")).agg(F.collect_list(key).alias(key))
    left = side(dealt("_pieces").drop("_part"), "a")
    right = side(dealt("_parts").withColumnRenamed("_part", "_at"), "b").withColumnRenamed("_at_b", "_at")
    many = pairs.join(side(sizes.select(*on, group, "_parts"), "b"), [*on, f"{group}_b"]).join(left, [*on, f"{group}_a"]).drop(f"{group}_a")
    many = many.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_parts_b") - 1))).drop("_parts_b")
    # little is sent and much is made of it, so tasks must not be joined by what they read: their number is given
    keys = [*on, f"{group}_b", "_at"]
    met = many.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).join(right.hint("shuffle_hash"), keys).drop("_at", f"{group}_b")
    return met.withColumn(f"{key}_a", F.explode(f"{key}_a")).withColumn(f"{key}_b", F.explode(f"{key}_b"))


def overlapping_pairs(rows: DataFrame, key: str, low: str, high: str, width: float, block: int = 10_000) -> DataFrame:
    """Pairs of keys ``a < b`` whose ranges meet as ``overlaps`` has it.

    Ranges that are alike meet the same ones: only distinct ranges are compared, through bins of
    ``width``, each pair in the first bin that both touch, and their rows are paired afterwards. Bins and ranges of
    more than ``block`` rows are split; ``a`` and ``b`` of rows that repeat a key don't pair with each other.
    """
    lo, hi = F.coalesce(low, high), F.coalesce(high, low)
    spans = rows.select(F.col(key).alias("k"), lo.alias("lo"), hi.alias("hi")).filter("k IS NOT NULL AND lo IS NOT NULL").withColumn("of", F.struct("lo", "hi"))
    bounds = spans.select("of", "lo", "hi").distinct().withColumns({"first": F.floor(F.least("lo", "hi") / width), "last": F.floor(F.greatest("lo", "hi") / width)})
    binned = bounds.withColumn("_bin", F.explode(F.sequence("first", "last"))).drop("last")
    meets = overlaps(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"))
    unlike = group_pairs(binned, ["_bin"], "of", block).filter((F.col("_bin") == F.greatest("first_a", "first_b")) & meets).select("of_a", "of_b", F.lit(False).alias("alike"))
    alike = bounds.filter(overlaps(F.col("lo"), F.col("hi"), F.col("lo"), F.col("hi"))).select(F.col("of").alias("of_a"), F.col("of").alias("of_b"), F.lit(True).alias("alike"))
    pairs = member_pairs(unlike.unionByName(alike), spans.select("of", "k"), [], "of", "k", min(block, 1_000))
    return pairs.filter("k_a < k_b OR (k_a > k_b AND NOT alike)").select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b"))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, on: Sequence[str] = (), block: int = 10_000) -> DataFrame:
    """Points joined to the ranges that hold them, through bins of ``width``, so that it is an equi-join.

    A range is repeated for every bin that it touches; choose a width near the usual
    range's. Only points of bins with ranges are sent. They meet distinct ranges, whose rows follow in arrays of about ``block``,
    made into rows of pairs last. A bin of more than ``block`` distinct ranges is split: its ranges are dealt to parts,
    and a point of the bin meets each part in a row of its own.
    """
    ends = [*on, low, high]
    held = ranges.filter(F.col(low) <= F.col(high))
    rest = [c for c in ranges.columns if c not in ends]
    bounds = held.select(*ends).distinct()
    right = bounds.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    left = points.withColumn("_bin", F.floor(F.col(point) / width))
    # bins by their remainder: few enough to go to every task, however many there are
    some = F.pmod("_bin", F.lit(65_536)).alias("_some")
    left = left.withColumn("_some", some).join(F.broadcast(right.select(some).distinct()), "_some", "left_semi").drop("_some")
    found = dealt_join(left, right, [*on, "_bin"], block).filter(F.col(point).between(F.col(low), F.col(high))).drop("_bin")
    sizes = held.groupBy(*ends).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    row = F.struct(*rest) if rest else F.struct(F.lit(True))
    arrays = held.join(sizes, ends).withColumn("_at", F.pmod(F.xxhash64(*ends, *rest), F.col("_parts")).cast("int")).groupBy(*ends, "_at").agg(F.collect_list(row).alias("_rows"))
    many = found.join(sizes, ends).withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    # floats as text: Spark deals their join keys in a form of its own, so rows dealt by them would be dealt again
    fractions = [c for c in ends if isinstance(ranges.schema[c].dataType, (DoubleType, FloatType))]
    keyed = lambda of: of.withColumns({f"_end{i}": F.col(c).cast("string") if c in fractions else F.col(c) for i, c in enumerate(ends)})
    keys = [*(f"_end{i}" for i in range(len(ends))), "_at"]
    met = keyed(many).repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).join(keyed(arrays).drop(*ends).hint("shuffle_hash"), keys)
    out = met.withColumn("_row", F.explode("_rows"))
    of = lambda c: F.col("_row")[c].alias(c) if c in rest else F.col(c)
    return out.select(*points.columns, *(of(c) for c in ranges.columns if c not in on))


def best_range(points: DataFrame, ranges: DataFrame, id_col: str, point: str, low: str, high: str, kind: str, range_id: str, width: float, block: int = 10_000) -> DataFrame:
    """For each point the range that holds it, one of the point's kind before others, then the smallest id; points without a range are left out.

    The line is cut into cells of ``width / 256`` and these, two by two, into larger ones. A range is sent to the largest
    cells that it covers, where only the smallest id of each kind stays, and to the two cells in which it
    ends, where alone points are compared with its ends: what meets a point doesn't grow with the ranges that hold it.
    """
    size = width / 256
    cell = lambda c: F.floor(F.col(c) / size)
    spans = ranges.filter(F.col(low) <= F.col(high)).groupBy(F.col(low).alias("_low"), F.col(high).alias("_high"), F.col(kind).alias("_kind")).agg(F.min(range_id).alias("_id"))
    spans = spans.withColumns({"_a": cell("_low"), "_b": cell("_high")})
    ends = spans.select(F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_cell"), "_low", "_high", "_kind", "_id")
    # of the cells of a level inside a range, the first and the last can have neighbours in the cell above that aren't
    level = F.expr("shiftleft(1L, _level)")
    inner = spans.filter("_b - _a > 1").select("_kind", "_id", (F.col("_a") + 1).alias("_a"), F.col("_b"), F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_b") - F.col("_a"))).cast("int"))).alias("_level"))
    inner = inner.withColumns({"_a": F.ceil(F.col("_a") / level), "_b": F.floor(F.col("_b") / level) - 1}).filter("_a <= _b")
    odd = lambda c: F.pmod(F.col(c), F.lit(2)) == 1
    outer = F.array_compact(F.array(F.when(odd("_a"), F.col("_a")), F.when(~odd("_b"), F.col("_b"))))
    covers = inner.select("_level", F.explode(outer).alias("_at"), "_kind", "_id").groupBy("_level", "_at", "_kind").agg(F.min("_id").alias("_id"))
    levels = covers.select("_level").distinct()
    asked = points.select(cell(point).alias("_cell")).filter("_cell IS NOT NULL").distinct().crossJoin(F.broadcast(levels))
    found = asked.withColumn("_at", F.expr("shiftright(_cell, _level)")).join(covers, ["_level", "_at"]).groupBy("_cell", "_kind").agg(F.min("_id").alias("_id"))
    everywhere = F.lit(None).cast(spans.schema["_low"].dataType)
    held = found.select("_cell", everywhere.alias("_low"), F.lit(None).cast(spans.schema["_high"].dataType).alias("_high"), "_kind", "_id").unionByName(ends)
    meets = dealt_join(points.withColumn("_cell", cell(point)), held, ["_cell"], block).filter(F.col("_low").isNull() | F.col(point).between(F.col("_low"), F.col("_high")))
    other = F.when(F.col(kind).eqNullSafe(F.col("_kind")), 0).otherwise(1)
    return meets.groupBy(id_col).agg(F.min(F.struct(other.alias("other"), F.col("_id"))).alias("_best")).select(id_col, F.col("_best._id").alias(range_id), (F.col("_best.other") == 0).alias("same_kind"))


def co_occurrence(members: DataFrame, group: str, item: str, label: str) -> DataFrame:
    """Pairs of items ``a < b`` that share a group, with the sorted labels of the groups that they share."""
    one = members.select(group, item, label).distinct()
    pairs = group_pairs(one, [group], item).withColumnsRenamed({f"{item}_a": "a", f"{item}_b": "b"})
    return pairs.groupBy("a", "b").agg(F.array_sort(F.collect_set(f"{label}_a")).alias("labels"))


def footnotes(markers: DataFrame, definitions: DataFrame) -> DataFrame:
    """Markers ``page, marker`` with the first definition ``page, marker, pos, body`` of their page."""
    first = definitions.groupBy("page", "marker").agg(F.min_by("body", "pos").alias("body"))
    return markers.join(first, ["page", "marker"], "left")


def definitions_of(pages: DataFrame, pattern: str = r"\((\d+)\)") -> DataFrame:
    """``page, marker, pos, body``: a definition runs from its marker to the next one."""
    rows = pages.select("page", "text", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("pos", "marker"), F.split("text", pattern).alias("parts"))
    return rows.select("page", "marker", "pos", F.trim(F.get("parts", F.col("pos") + 1)).alias("body"))


def resolve(instances: DataFrame, types: DataFrame, rules: DataFrame) -> DataFrame:
    """Types ``type_id, label`` with an instance: by the instance's own type name, else by a rule edge; smallest id wins.

    ``instances(instance_id, component_type)``, ``rules(source_id, target_id)``.
    """
    direct = instances.groupBy(F.lower("component_type").alias("_t")).agg(F.min("instance_id").alias("direct"))
    ruled = rules.join(instances, F.col("target_id") == F.col("instance_id"), "left_semi").groupBy(F.col("source_id").alias("_s")).agg(F.min("target_id").alias("ruled"))
    out = types.join(direct, F.lower("label") == F.col("_t"), "left").join(ruled, F.col("type_id") == F.col("_s"), "left")
    return out.select(*types.columns, F.coalesce("direct", "ruled").alias("instance_id"), F.when(F.col("direct").isNotNull(), "property").when(F.col("ruled").isNotNull(), "rule").alias("via"))


def unresolved_requirements(requirements: DataFrame, blocks: DataFrame) -> DataFrame:
    """Requirements ``slug`` without a block whose slug is equal or whose id's last part is."""
    last = blocks.filter(F.contains("block_id", F.lit(":"))).select(F.element_at(F.split("block_id", ":"), -1).alias("_known"))
    known = blocks.select(F.col("block_slug").alias("_known")).unionByName(last).distinct()
    return requirements.join(known, F.col("slug") == F.col("_known"), "left_anti")


def triangles(edges: DataFrame, induced_without: DataFrame | None = None) -> DataFrame:
    """Triangles a < b < c of undirected ``edges(u, v)``; hubs are kept cheap by directing edges to the larger degree."""
    plain = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
    degree = plain.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    both = plain.join(degree.withColumnsRenamed({"n": "u", "d": "du"}), "u").join(degree.withColumnsRenamed({"n": "v", "d": "dv"}), "v")
    forward = F.struct("du", "u") < F.struct("dv", "v")
    out = both.select(F.when(forward, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("t"))
    two = out.join(out.select(F.col("s"), F.col("t").alias("t2")), "s").filter("t < t2")
    closed = two.join(plain, (F.col("t") == F.col("u")) & (F.col("t2") == F.col("v")), "left_semi")
    three = F.array_sort(F.array("s", "t", "t2"))
    found = closed.select(*(F.element_at(three, i + 1).alias(n) for i, n in enumerate("abc")))
    return found if induced_without is None else found.join(induced_without, ["a", "b", "c"], "left_anti")


def chain_motif(edges: DataFrame, kinds: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Induced paths x1 - x2 - ... of undirected ``edges(u, v)`` whose vertices have the ``wanted`` kinds.

    ``kinds(node, kind)`` is filtered first, so only vertices of the right kind are joined;
    a path with an edge between vertices that aren't neighbours on it doesn't count.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    of = lambda i: kinds.filter(F.col("kind") == wanted[i]).select(F.col("node").alias(f"x{i + 1}"))
    found = of(0)
    for i in range(1, len(wanted)):
        step = both.select(F.col("u").alias(f"x{i}"), F.col("v").alias(f"x{i + 1}")).join(of(i), f"x{i + 1}", "left_semi")
        found = found.join(step, f"x{i}")
        for j in range(1, i):
            found = found.filter(F.col(f"x{j}") != F.col(f"x{i + 1}"))
            found = found.join(both, (F.col(f"x{j}") == F.col("u")) & (F.col(f"x{i + 1}") == F.col("v")), "left_anti")
    return found.select(*(f"x{i + 1}" for i in range(len(wanted))))


def keep_best_boxes(boxes: DataFrame, group: Sequence[str], limit: float = 0.5) -> DataFrame:
    """Greedy suppression of boxes ``x0, y0, x1, y1, confidence, box_id`` that overlap a better one of their group.

    Each decision depends on the ones before it, so a group (a page) is one pandas frame.
    """
    import numpy as np
    import pandas as pd

    def greedy(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["confidence", "box_id"], ascending=[False, True])
        x0, y0, x1, y1 = (page[c].to_numpy(float) for c in ("x0", "y0", "x1", "y1"))
        area, kept, left = (x1 - x0) * (y1 - y0), [], np.arange(len(page))
        while len(left):
            best, left = left[0], left[1:]
            kept.append(best)
            w = np.minimum(x1[best], x1[left]) - np.maximum(x0[best], x0[left])
            h = np.minimum(y1[best], y1[left]) - np.maximum(y0[best], y0[left])
            inter = np.maximum(w, 0) * np.maximum(h, 0)
            union = area[best] + area[left] - inter
            left = left[inter / np.where(union > 0, union, 1) * (union > 0) < limit]
        return page.iloc[kept]

    return boxes.groupBy(*group).applyInPandas(greedy, boxes.schema)


def nearest_before(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """As-of join (an extension): each left row with the last right value at or before its time; one union and window."""
    a = left.select(*on, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    b = right.select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    over = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_last", F.last("_v", True).over(over)).filter("_side = 1").select("_row.*", F.col("_last").alias(value))
