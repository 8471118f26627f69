"""Rule sets over long tables; each returns violations, and scores follow from counting them.

Nets: net_pins(design_id, net_name, net_type, ref, pin_number). Pins: pins(design_id, ref,
pin_number, pin_type, function, role, pin_name).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.session import written

from .aggregates import penalty_score
from .joins import apart_pairs, group_pairs

KEY = ["design_id", "net_name"]
_REFS = "array<string>"

#: Pin types and functions that the checks tell apart.
OUTPUTS, INPUTS = ("output", "io"), ("input", "io")
POWER_FUNCTIONS = ("POWER_POSITIVE", "POWER_GROUND", "POWER_INPUT")
REQUIRED_FUNCTIONS = ("POWER_POSITIVE", "POWER_GROUND", "ENABLE", "RESET")
DRIVER_ROLES = ("POWER_OUT", "SIGNAL_OUT", "ANALOG_OUT")


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _on_nets(nets: DataFrame, pins: DataFrame) -> DataFrame:
    return nets.join(pins.select("design_id", "ref", "pin_number", "pin_type", "function", "role"), ["design_id", "ref", "pin_number"], "left")


def _violation(rows: DataFrame, severity: str, rule: str, refs: Column, subject: Column) -> DataFrame:
    return rows.select("design_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), subject.alias("subject"), refs.cast(_REFS).alias("refs"))


def electrical_checks(nets: DataFrame, pins: DataFrame) -> DataFrame:
    """Five checks: output conflicts, supply nets without a source, floating required pins, mixed levels, floating inputs.

    One join and one aggregation: a required pin that no net has is a group of its own. What the checks ask
    is counted apart from the refs that they list, so that callers who drop the refs don't collect them.
    """
    place = ["design_id", "ref", "pin_number"]
    on = nets.withColumn("_net", F.lit(True)).join(pins.select(*place, "pin_type", "function"), place, "full")
    required = F.col("_net").isNull() & F.col("function").isin(*REQUIRED_FUNCTIONS)
    on = on.withColumn("floating", F.when(required, F.struct("ref", "pin_number"))).filter(F.col("_net") | required)
    driver = F.when(F.col("pin_type").isin(*OUTPUTS), F.col("ref"))
    listener = F.when(F.col("pin_type").isin(*INPUTS) & ~F.coalesce(F.col("function").isin(*POWER_FUNCTIONS), F.lit(False)), F.col("ref"))
    refs = lambda c: F.array_sort(F.collect_set(c))
    per = on.groupBy(*KEY, "net_type", "floating").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("pin_type").isin(*OUTPUTS)).alias("outputs"),
        F.count(driver).alias("n_drivers"),
        F.count(listener).alias("n_inputs"),
        F.bool_or(F.coalesce(F.col("function") == "POWER_POSITIVE", F.lit(False)) | F.contains(F.lower("ref"), F.lit("regulator"))).alias("sourced"),
        refs(driver).alias("drivers"),
        refs(listener).alias("inputs"),
        refs("ref").alias("all_refs"),
    )
    name = F.col("net_name")
    rules = {
        "no_output_conflict": F.col("outputs") > 1,
        "power_net_has_source": F.startswith(name, F.lit("VCC")) & ~F.col("sourced"),
        "no_logic_level_mismatch": F.contains(F.upper(name), F.lit("3V3")) & F.contains(F.upper(name), F.lit("5V")),
        "no_floating_inputs": (F.col("net_type") != "power") & (F.col("n_drivers") == 0) & (F.col("n_inputs") > 0),
    }
    loose = F.col("floating").isNotNull()
    broken = F.when(loose, F.array_repeat(F.lit("no_required_pin_floating"), F.col("n").cast("int"))).otherwise(F.array_compact(F.array(*(F.when(fails, rule) for rule, fails in rules.items()))))
    found = per.withColumn("rule", F.explode(broken))
    listed = F.when(loose, F.array("floating.ref")).when(F.col("rule") == "no_output_conflict", F.col("drivers")).when(F.col("rule") == "no_floating_inputs", F.col("inputs")).otherwise(F.col("all_refs"))
    severity = F.when(F.col("rule").isin("no_logic_level_mismatch", "no_floating_inputs"), "WARNING").otherwise("CRITICAL")
    subject = F.when(loose, F.concat_ws(".", "floating.ref", "floating.pin_number")).otherwise(name)
    return found.select("design_id", severity.alias("severity"), "rule", subject.alias("subject"), listed.cast(_REFS).alias("refs"))


def role_checks(nets: DataFrame, pins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(violations, checked)``: several drivers of one role, connected NC pins, undriven power nets."""
    on = _on_nets(nets, pins)
    size = on.groupBy(*KEY, "net_type").agg(F.count("*").alias("n"), F.count("role").alias("known"), F.bool_or(F.col("role").isin("POWER_OUT", "GROUND")).alias("driven"))
    drivers = on.filter(F.col("role").isin(*DRIVER_ROLES)).groupBy(*KEY, "role").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("ref")).alias("refs")).filter("n > 1")
    unconnected = on.filter(F.col("role") == "NC").join(size.filter("n > 1"), KEY, "left_semi")
    violations = union(
        [
            _violation(drivers, "CRITICAL", "driver_conflict", F.col("refs"), F.concat_ws(":", "net_name", "role")),
            _violation(unconnected, "CRITICAL", "nc_connected", F.array("ref"), F.concat_ws(".", "ref", "pin_number")),
            _violation(size.filter((F.col("net_type") == "power") & (F.col("known") > 0) & ~F.coalesce("driven", F.lit(False))), "WARNING", "power_undriven", F.array(), F.col("net_name")),
        ]
    )
    checked = size.groupBy("design_id").agg(F.sum(F.when(F.col("net_type") == "power", 3).otherwise(2)).alias("checked"))
    return violations, checked


#: Roles that a type must have connected, by a part of the type's name.
TEMPLATES = {
    "op_amp": ("POWER_IN", "SIGNAL_OUT"), "opamp": ("POWER_IN", "SIGNAL_OUT"), "comparator": ("POWER_IN", "SIGNAL_OUT"), "ldo": ("POWER_IN", "GROUND", "POWER_OUT"), "ldo_regulator": ("POWER_IN", "GROUND", "POWER_OUT"),
    "buck": ("POWER_IN", "GROUND", "POWER_OUT"), "boost": ("POWER_IN", "GROUND", "POWER_OUT"), "adc": ("POWER_IN", "GROUND", "ANALOG_IN"), "dac": ("POWER_IN", "GROUND", "ANALOG_OUT"),
    "microcontroller": ("POWER_IN", "GROUND"), "mcu": ("POWER_IN", "GROUND"), "mosfet": ("ENABLE",), "gate_driver": ("POWER_IN", "SIGNAL_IN"), "current_source": ("POWER_IN", "GROUND"),
}


def template_checks(nets: DataFrame, pins: DataFrame, bom: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(violations, checked)`` for ``bom(design_id, ref, component_type)``: a missing role warns, an unconnected one is critical."""
    low = F.lower("component_type")
    roles = F.array_distinct(F.flatten(F.array(*(F.when(F.contains(low, F.lit(k)), F.array(*map(F.lit, r))).otherwise(F.array().cast(_REFS)) for k, r in TEMPLATES.items()))))
    with_pins = bom.join(pins.select("design_id", "ref").distinct(), ["design_id", "ref"], "left_semi")
    needed = with_pins.select("design_id", "ref", F.explode(roles).alias("role"))
    linked = nets.select("design_id", "ref", "pin_number").distinct().withColumn("linked", F.lit(True))
    have = pins.filter("role IS NOT NULL").join(linked, ["design_id", "ref", "pin_number"], "left").groupBy("design_id", "ref", "role").agg(F.coalesce(F.bool_or("linked"), F.lit(False)).alias("linked"))
    state = needed.join(have, ["design_id", "ref", "role"], "left")
    subject = F.concat_ws(":", "ref", "role")
    violations = union([_violation(state.filter("linked IS NULL"), "WARNING", "role_missing", F.array("ref"), subject), _violation(state.filter("NOT linked"), "CRITICAL", "role_unconnected", F.array("ref"), subject)])
    return violations, needed.groupBy("design_id").agg(F.count("*").alias("checked"))


def ground_checks(nets: DataFrame, pins: DataFrame, bom: DataFrame, analog: Sequence[str] = ("op_amp", "adc", "dac", "amplifier", "comparator"), digital: Sequence[str] = ("microcontroller", "mcu", "fpga", "processor"), most: int = 3) -> DataFrame:
    """Too many ground nets, sense pins on the output's net, grounds that analog and digital parts share."""
    on = _on_nets(nets, pins)
    grounds = on.filter("role = 'GROUND'").select(*KEY).distinct().groupBy("design_id").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    sense = on.filter(F.col("role").isin("SENSE_POS", "SENSE_NEG")).select("design_id", "ref", "net_name").distinct()
    shorted = sense.join(on.filter("role = 'POWER_OUT'").select("design_id", "ref", "net_name").distinct(), ["design_id", "ref", "net_name"])
    low = F.lower("component_type")
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    kinds = bom.select("design_id", "ref", has(analog).alias("a"), has(digital).alias("d"))
    shared = on.filter("role = 'GROUND'").join(kinds, ["design_id", "ref"]).groupBy(*KEY).agg(F.bool_or("a").alias("a"), F.bool_or("d").alias("d"), F.array_sort(F.collect_set("ref")).alias("refs")).filter("a AND d")
    return union([_violation(grounds, "WARNING", "many_grounds", F.array(), F.col("n").cast("string")), _violation(shorted, "CRITICAL", "kelvin_short", F.array("ref"), F.col("net_name")), _violation(shared, "WARNING", "shared_ground", F.col("refs"), F.col("net_name"))])


#: Circuit patterns; vertices with the word that their type must contain, and edges with the net type that they must share.
PATTERNS = {
    "ldo": ({"src": "", "ldo": "ldo", "load": "", "gnd": ""}, (("src", "ldo", "power"), ("ldo", "load", "power"), ("ldo", "gnd", "ground"), ("load", "gnd", "ground"))),
    "buck_converter": ({"src": "", "buck": "buck", "ind": "inductor", "load": "", "gnd": ""}, (("src", "buck", "power"), ("buck", "ind", None), ("ind", "load", "power"), ("load", "gnd", "ground"), ("buck", "gnd", "ground"))),
    "inverting_amplifier": ({"amp": "op_amp", "r_in": "resistor", "r_fb": "resistor", "vcc": "", "gnd": ""}, (("amp", "r_in", None), ("amp", "r_fb", None), ("amp", "vcc", "power"), ("amp", "gnd", "ground"))),
    "voltage_divider": ({"r_top": "resistor", "r_bot": "resistor", "vcc": "", "gnd": ""}, (("vcc", "r_top", "power"), ("r_top", "r_bot", None), ("r_bot", "gnd", "ground"))),
    "rc_lowpass": ({"r": "resistor", "c": "capacitor", "src": "", "gnd": ""}, (("src", "r", None), ("r", "c", None), ("c", "gnd", "ground"))),
    "current_source": ({"amp": "op_amp", "r_set": "resistor", "vcc": "", "gnd": ""}, (("amp", "r_set", None), ("amp", "vcc", "power"), ("r_set", "gnd", "ground"))),
}


def connections(nets: DataFrame, bom: DataFrame, block: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``(vertices, edges)``: every ref on a net with its lower-cased type, and every ordered pair of refs that share one, with whether a power or ground net is among them.

    Both are written once, since patterns join the edges for each of their pairs; nets of
    more than ``block`` refs are paired in blocks.
    """
    on = nets.select("design_id", "net_name", "ref", F.coalesce("net_type", F.lit("signal")).alias("net_type")).distinct()
    vertices = on.select("design_id", "ref").distinct().join(bom.select("design_id", "ref", F.lower("component_type").alias("kind")), ["design_id", "ref"], "left")
    types = on.groupBy("design_id", "net_name", "ref").agg(F.bool_or(F.col("net_type") == "power").alias("power"), F.bool_or(F.col("net_type") == "ground").alias("ground"))
    pairs = group_pairs(types, ["design_id", "net_name"], "ref", block)
    one = pairs.groupBy("design_id", "ref_a", "ref_b").agg(*(F.struct(F.bool_or(f"{t}_a").alias("a"), F.bool_or(f"{t}_b").alias("b")).alias(t) for t in ("power", "ground")))
    ends = F.explode(F.array(*(F.struct(F.col(f"ref_{x}").alias("ref"), F.col(f"ref_{y}").alias("other"), F.col(f"power.{x}").alias("power"), F.col(f"ground.{x}").alias("ground")) for x, y in ("ab", "ba"))))
    return written(vertices.fillna("", ["kind"])), written(one.select("design_id", ends.alias("e")).select("design_id", "e.*"))


def _binding(name: str) -> tuple[list[str], dict[frozenset[str], str | None]]:
    """A pattern's vertices in the order in which they are bound, those with a word first, and its edges."""
    kinds, links = PATTERNS[name]
    wanted = {frozenset(e[:2]): e[2] for e in links}
    order = [next(v for v, word in kinds.items() if word)]
    while len(order) < len(kinds):
        near = [v for v in kinds if v not in order and any(frozenset((v, o)) in wanted for o in order)]
        order.append(next((v for v in near if kinds[v]), near[0]))
    return order, wanted


def pattern_found(name: str, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Designs that hold a pattern as an induced subgraph.

    Vertices are bound one after the other, those with a word first, each joined through
    an edge to one that is bound; pairs without an edge in the pattern must have none.
    """
    kinds = PATTERNS[name][0]
    fits = lambda word: vertices.filter(F.contains("kind", F.lit(word))) if word else vertices
    order, wanted = _binding(name)
    bound = fits(kinds[order[0]]).select("design_id", F.col("ref").alias(order[0]))
    for i, v in enumerate(order[1:], 1):
        first = next(o for o in order[:i] if frozenset((v, o)) in wanted)
        bound = bound.join(edges.select("design_id", F.col("ref").alias(first), F.col("other").alias(v), F.col("power").alias("_p"), F.col("ground").alias("_g")), ["design_id", first])
        bound = bound.filter(_carries(wanted[frozenset((v, first))])).drop("_p", "_g")
        if kinds[v]:
            bound = bound.join(fits(kinds[v]).select("design_id", F.col("ref").alias(v)), ["design_id", v], "left_semi")
        for o in order[:i]:
            if o == first:
                continue
            bound = bound.filter(F.col(v) != F.col(o))
            pair = edges.select("design_id", F.col("ref").alias(o), F.col("other").alias(v), F.col("power").alias("_p"), F.col("ground").alias("_g"))
            if frozenset((v, o)) in wanted:
                bound = bound.join(pair, ["design_id", o, v]).filter(_carries(wanted[frozenset((v, o))])).drop("_p", "_g")
            else:
                bound = bound.join(pair, ["design_id", o, v], "left_anti")
    return bound.select("design_id").distinct()


def _carries(kind: str | None) -> Column:
    return F.lit(True) if kind is None else F.col("_p") | F.col("_g") if kind == "ground" else F.col("_p")


def _word(name: str) -> str:
    return next(w for w in PATTERNS[name][0].values() if w)


def _bind(steps: list[tuple[str, list[tuple[int, str]]]], fits: dict[str, int], near: dict[str, list[int]], bound: tuple[int, ...] = ()) -> bool:
    """Whether the vertices ``bound`` can be followed to the end of ``steps``; sets of refs are the bits of a number."""
    if len(bound) == len(steps):
        return True
    word, links = steps[len(bound)]
    free = fits[word]
    for at, kind in links:
        free &= near[kind][bound[at]]
    for v in bound:
        free &= ~(1 << v)
    while free:
        low = free & -free
        if _bind(steps, fits, near, (*bound, low.bit_length() - 1)):
            return True
        free ^= low
    return False


def _in_rows(designs: DataFrame, names: Sequence[str]) -> DataFrame:
    """``design_id, n, asked, found`` of designs of a row each: ``pins(net, ref, type)`` and ``kinds(ref, kind)``."""
    words = {w for name in names for w in PATTERNS[name][0].values()}
    steps = {}
    for name in names:
        order, wanted = _binding(name)
        steps[name] = [(PATTERNS[name][0][v], [(j, (wanted[e] or "any") if (e := frozenset((v, o))) in wanted else "apart") for j, o in enumerate(order[:i])]) for i, v in enumerate(order)]

    def one(pins: list[dict], kinds: list[dict]) -> tuple[int, list[str], list[str]]:
        asked = [name for name in names if any(_word(name) in k["kind"] for k in kinds if k["kind"] is not None)]
        place = {r: i for i, r in enumerate(dict.fromkeys(p["ref"] for p in pins if p["ref"] is not None))}
        rows = dict.fromkeys(place, 0)
        fits = dict.fromkeys(words, 0)
        fits[""] = (1 << len(place)) - 1
        for k in kinds:
            if k["ref"] in place:
                rows[k["ref"]] += 1
                for w in words:
                    if w and w in (k["kind"] or ""):
                        fits[w] |= 1 << place[k["ref"]]
        n = sum(max(1, x) for x in rows.values()) + any(p["ref"] is None for p in pins)
        if any(fits[_word(name)] for name in asked):
            nets: dict[str, int] = {}
            for p in pins:
                if p["ref"] is not None and p["net"] is not None:
                    nets[p["net"]] = nets.get(p["net"], 0) | 1 << place[p["ref"]]
            near = {kind: [0] * len(place) for kind in ("any", "power", "ground")}
            for p in pins:
                if p["ref"] is not None and p["net"] is not None:
                    i = place[p["ref"]]
                    others = nets[p["net"]] & ~(1 << i)
                    near["any"][i] |= others
                    if p["type"] == "power":
                        near["power"][i] |= others
                    if p["type"] in ("power", "ground"):
                        near["ground"][i] |= others
            near["apart"] = [~x for x in near["any"]]
            return n, asked, [name for name in asked if _bind(steps[name], fits, near)]
        return n, asked, []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(p or [], k or []) for p, k in zip(batch.column("pins").to_pylist(), batch.column("kinds").to_pylist(), strict=True)]
            names_of = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("design_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], names_of), pa.array([x[2] for x in out], names_of)], names=["design_id", "n", "asked", "found"])

    return designs.mapInArrow(search, f"design_id {designs.schema['design_id'].dataType.simpleString()}, n long, asked array<string>, found array<string>")


def _in_joins(nets: DataFrame, bom: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same for designs of any size, by joins."""
    vertices, edges = connections(nets, bom)
    size = vertices.groupBy("design_id").agg(F.count("*").alias("n"))
    hits = union([pattern_found(name, vertices, edges).withColumn("name", F.lit(name)) for name in names]).groupBy("design_id").agg(F.collect_set("name").alias("found"))
    words = [F.when(F.bool_or(F.contains(F.lower("component_type"), F.lit(_word(name)))), F.lit(name)) for name in names]
    asked = bom.groupBy("design_id").agg(F.array_compact(F.array(*words)).alias("asked"))
    both = asked.join(size, "design_id", "full").join(hits, "design_id", "left")
    return both.select("design_id", F.coalesce("n", F.lit(0)).alias("n"), *(F.coalesce(c, F.array().cast(_REFS)).alias(c) for c in ("asked", "found")))


def patterns_in(nets: DataFrame, bom: DataFrame, names: Sequence[str], most: int = 64) -> DataFrame:
    """``design_id, n, asked, found``: a design's refs on nets, the patterns of ``names`` whose word is in its types, and which of these it holds.

    A design of up to ``most`` rows of both tables is put into one row and searched there,
    so that tables, written once, are dealt by design once; larger ones are searched by joins of their edges.
    """
    nets, bom = written(nets.select("design_id", "net_name", "net_type", "ref")), written(bom.select("design_id", "ref", "component_type"))
    rows = nets.select("design_id").unionByName(bom.select("design_id")).groupBy("design_id").agg(F.count("*").alias("n"))
    large = written(rows.filter(F.col("n") > most).select("design_id"))
    some = large.limit(1).count() > 0
    same = lambda df: df["design_id"].eqNullSafe(large["design_id"])
    of = lambda df, how: df.join(large, same(df), how) if some else df
    pins = of(nets, "left_anti").groupBy("design_id").agg(F.collect_list(F.struct(F.col("net_name").alias("net"), "ref", F.col("net_type").alias("type"))).alias("pins"))
    kinds = of(bom, "left_anti").groupBy("design_id").agg(F.collect_list(F.struct("ref", F.lower("component_type").alias("kind"))).alias("kinds"))
    found = _in_rows(pins.join(kinds, "design_id", "full"), names)
    return written(found.unionByName(_in_joins(of(nets, "left_semi"), of(bom, "left_semi"), names)) if some else found)


def topology_checks(nets: DataFrame, bom: DataFrame, names: Sequence[str] = tuple(PATTERNS), most: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(violations, checked)``: of the patterns whose word is in a design's types, those that it lacks.

    A design with fewer refs than a pattern has vertices gets a warning, any other a
    critical finding; designs of up to ``most`` rows are searched in one row.
    """
    per = patterns_in(nets, bom, names, most)
    due = per.select("design_id", "n", "found", F.explode("asked").alias("name"))
    few = F.col("n") < reduce(lambda c, name: c.when(F.col("name") == name, len(PATTERNS[name][0])), names, F)
    violations = due.filter(few | ~F.array_contains("found", F.col("name"))).select("design_id", F.when(few, "WARNING").otherwise("CRITICAL").alias("severity"), F.when(few, "topology_too_small").otherwise("topology_missing").alias("rule"), F.col("name").alias("subject"), F.array().cast(_REFS).alias("refs"))
    return violations, per.filter(F.size("asked") > 0).select("design_id", F.size("asked").cast("long").alias("checked"))


def scores(violations: DataFrame, checked: DataFrame) -> DataFrame:
    """Score of each design from its violations and the number of checks."""
    per = violations.groupBy("design_id").agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "WARNING").alias("warning"))
    joined = checked.join(per, "design_id", "left").fillna(0, ["critical", "warning"])
    return joined.select("design_id", "checked", "critical", "warning", penalty_score(F.col("checked"), F.col("critical"), F.col("warning")).alias("score"))


def netlist_checks(components: DataFrame, nets: DataFrame, placements: DataFrame, sources: Sequence[str] = ("VOUT", "VCC", "VDD", "OUT", "POWER_POSITIVE")) -> DataFrame:
    """Unknown refs on nets and in placements, single-pin nets, power nets with no or several sources, components without confidence.

    ``nets`` has pin_name; ``components(design_id, ref, datasheet_confidence)``.
    """
    refs = components.select("design_id", "ref")
    per = nets.groupBy(*KEY, "net_type").agg(F.count("*").alias("n"), F.count_if(F.col("pin_name").isin(*sources)).alias("sources"))
    power, name, none = F.col("net_type") == "power", F.col("net_name"), F.array()
    return union(
        [
            _violation(nets.join(refs, ["design_id", "ref"], "left_anti"), "CRITICAL", "unknown_net_ref", F.array("ref"), name),
            _violation(placements.join(refs, ["design_id", "ref"], "left_anti"), "CRITICAL", "unknown_placement_ref", F.array("ref"), F.col("ref")),
            _violation(per.filter(~power & (F.col("n") < 2)), "WARNING", "single_pin_net", none, name),
            _violation(per.filter(power & (F.col("sources") == 0)), "CRITICAL", "power_without_source", none, name),
            _violation(per.filter(power & (F.col("sources") > 1)), "WARNING", "power_with_many_sources", none, name),
            _violation(components.filter("datasheet_confidence = 0"), "WARNING", "zero_confidence", F.array("ref"), F.col("ref")),
        ]
    )


def bom_checks(bom: DataFrame, cache: DataFrame, power: Column, logic: Column) -> DataFrame:
    """Output voltages more than 0.1 V apart, logic levels more than 0.5 V apart, parts that suppliers don't stock.

    ``bom(design_id, pos, ref, component_type, part, constraints map<string,string>)``,
    ``cache(part, status)``; values that aren't numbers don't take part.
    """
    number = lambda key: F.expr(f"try_cast(constraints['{key}'] AS DOUBLE)")
    parts = []
    for key, kind, gap, rule in (("output_voltage", power, 0.1, "voltage_conflict"), ("logic_voltage", logic, 0.5, "logic_mismatch")):
        rows = bom.filter(kind).select("design_id", "pos", "ref", number(key).alias("v"))
        pairs = apart_pairs(rows.select("design_id", "pos", "v"), ["design_id"], "pos", "v", gap)
        named = pairs.join(rows.select("design_id", F.col("pos").alias("pos_a"), F.col("ref").alias("ra")), ["design_id", "pos_a"]).join(rows.select("design_id", F.col("pos").alias("pos_b"), F.col("ref").alias("rb")), ["design_id", "pos_b"])
        parts.append(_violation(named, "WARNING", rule, F.array("ra", "rb"), F.concat_ws("/", "ra", "rb")))
    stock = bom.join(cache, "part", "left").filter(F.coalesce("status", F.lit("unknown")).isin("obsolete", "unavailable"))
    return union([*parts, _violation(stock, "WARNING", "not_available", F.array("ref"), F.col("part"))])


def bom_review(bom: DataFrame, scored: DataFrame) -> DataFrame:
    """Designs to review: score under 0.85, an entry under 0.75 or one without a part."""
    per = bom.groupBy("design_id").agg(F.bool_or(F.col("confidence") < 0.75).alias("low"), F.bool_or(F.col("part").isNull()).alias("open"))
    return scored.join(per, "design_id", "left").select("design_id", (F.coalesce(F.col("score") < 0.85, F.lit(True)) | F.coalesce("low", F.lit(False)) | F.coalesce("open", F.lit(False))).alias("review"))


#: Plausible ranges by symbol.
SANE = {"en": (0.1, 5000.0), "VOS_drift": (0.001, 1000.0), "PSRR": (0.0, 150.0), "TC": (0.001, 500.0), "V_CC": (0.5, 60.0), "I_CC": (0.001, 5000.0), "T_J": (-55.0, 175.0)}


def quality_gate(parameters: DataFrame, key: str = "component_id", least: float = 0.70) -> DataFrame:
    """For each component: failed, low-confidence and implausible parameter names, and whether it passed."""
    low = F.coalesce("confidence", F.lit(1.0)) < least
    reversed_ = F.coalesce(F.col("value_min") > F.col("value_max"), F.lit(False))
    outside = reduce(lambda a, b: a | b, ((F.col("symbol") == s) & reduce(lambda a, b: a | b, (F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)) for c in ("value_typ", "value_max"))) for s, (lo, hi) in SANE.items()))
    names = lambda cond, name: F.array_sort(F.collect_set(F.when(cond, F.col("parameter_name")))).alias(name)
    out = parameters.groupBy(key).agg(names(low | reversed_, "failed"), names(low, "low_confidence"), names(F.coalesce(outside, F.lit(False)), "warnings"))
    return out.withColumn("passed", F.size("failed") == 0)


def ordering_problems(parameters: DataFrame) -> DataFrame:
    """Rows whose min, typ and max aren't in order; min against max only where typ is missing."""
    lo, typ, hi = F.col("value_min"), F.col("value_typ"), F.col("value_max")
    kind = F.coalesce(F.when(lo > typ, "min_above_typ"), F.when(typ > hi, "typ_above_max"), F.when(typ.isNull() & (lo > hi), "min_above_max"))
    return parameters.withColumn("problem", kind).filter("problem IS NOT NULL")


def limits_exceeded(operating: DataFrame, absolute: DataFrame, key: str = "component_id") -> DataFrame:
    """Operating maxima above the absolute maximum of the same parameter, names compared without case and suffix."""
    base = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"([_ ]*(abs|max|absolute|maximum|rating))+$", "")
    a = operating.select(key, base("parameter_name").alias("name"), F.col("value_max").alias("operating_max"))
    b = absolute.select(key, base("parameter_name").alias("name"), F.col("value_max").alias("absolute_max"))
    return a.join(b, [key, "name"]).filter("operating_max > absolute_max")


def cross_checks(parameters: DataFrame, key: str = "component_id") -> DataFrame:
    """Rules between parameters of a component; a missing value skips the rule. ``parameters(symbol, value_min, value_max)``."""
    of = lambda s, c: F.max(F.when(F.col("symbol") == s, F.col(c)))
    wide = parameters.groupBy(key).agg(of("V_CC", "value_max").alias("vcc"), of("V_IL", "value_max").alias("vil"), of("V_IH", "value_min").alias("vih"), of("V_OL", "value_max").alias("vol"), of("V_OH", "value_min").alias("voh"))
    rules = {"vil_below_vih": "vil >= vih", "vol_below_voh": "vol >= voh", "vih_within_vcc": "vih > vcc", "voh_within_vcc": "voh > vcc", "vol_below_vil": "vol > vil"}
    broken = F.array_compact(F.array(*(F.when(F.expr(test), F.lit(name)) for name, test in rules.items())))
    return wide.select(key, F.explode(broken).alias("rule"))


def verdict(confidence: Column, flags: Column) -> Column:
    return F.when(confidence < 0.3, "BLOCK").when((confidence < 0.7) | (F.size(flags) > 0), "WARN").otherwise("PASS")


def interval_conflicts(intents: DataFrame) -> DataFrame:
    """Supply too low for output and dropout, rails beyond the power budget, a noise limit below the parts' own.

    ``intents(design_id, topology, supply_max_v, output_v, output_ma, budget_mw)``, and
    ``noise_limit_uv, noise_have_uv`` where they are given.
    """
    dropout = F.when(F.col("topology").isin("ldo", "linear_regulator"), F.lit(0.3)).when(F.col("topology").isin("buck_converter", "buck"), F.lit(0.0))
    need, power = F.round(F.col("output_v") + dropout, 6), F.col("output_v") * F.col("output_ma")
    found = F.array_compact(F.array(F.when(F.col("supply_max_v") < need, F.lit("voltage_chain")), F.when(power > F.col("budget_mw"), F.lit("power_budget")), F.when(F.col("noise_have_uv") > F.col("noise_limit_uv"), F.lit("noise_pair")) if "noise_limit_uv" in intents.columns else F.lit(None).cast("string")))
    return intents.select("design_id", need.alias("min_input_v"), power.alias("required_mw"), (F.col("budget_mw") - power).alias("remaining_mw"), found.alias("conflicts"))


def check_constraints(rows: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """``check, key`` of rows for which a named condition doesn't hold; null counts as holding."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items())))
    return rows.select(F.col(key), F.explode(broken).alias("check"))


def out_of_range(parameters: DataFrame, ranges: DataFrame, most: int = 1000) -> DataFrame:
    """Parameters ``name, value_min, value_typ, value_max`` with a value outside the first range whose pattern the name contains, and that range.

    ``ranges(pos, pattern, low, high)`` are settings, ``most`` at most; more are an error. Rows alike stay apart.
    """
    rules = ranges.orderBy("pos").limit(most + 1).collect()
    if len(rules) > most:
        raise ValueError(f"more than {most} ranges")
    name = F.lower("name")
    first = [F.when(F.contains(name, F.lit(r.pattern.lower())), F.struct(F.lit(r.low).cast("double").alias("low"), F.lit(r.high).cast("double").alias("high"))) for r in rules]
    hit = parameters.withColumn("_r", F.coalesce(*first) if first else F.lit(None).cast("struct<low:double,high:double>"))
    values = F.array_compact(F.array("value_min", "value_typ", "value_max"))
    return hit.filter(F.exists(values, lambda v: (v < F.col("_r.low")) | (v > F.col("_r.high")))).select(*parameters.columns, "_r.low", "_r.high")


def placement_problems(constraints: DataFrame) -> DataFrame:
    """Constraints without a subject or of a confidence under 0.65."""
    blank = F.coalesce(F.trim("subject"), F.lit("")) == ""
    problem = F.when(blank, "no_subject").when(F.coalesce(F.col("confidence") < 0.65, F.lit(True)), "low_confidence")
    return constraints.withColumn("problem", problem).filter("problem IS NOT NULL")
