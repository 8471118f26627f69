"""Graphs from triples and data sheets, and joins whose bins and nets are split."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from fathomgrid.operators import graph as G
from fathomgrid.operators import joins as J
from fathomgrid.operators import knowledge as N
from fathomgrid.operators import rules as K


def test_measured(spark):
    texts = {"10kΩ": True, "gain 3.5 dB": True, "4.7 µF": True, "5 of them": True, "1.5x": True, "2N3904": False, "X5Z": False, "op amp": False, "": False, "12bits": False, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.measured(F.col("t")).alias("m"))
    assert {r.t: r.m for r in rows.collect()} == texts


def test_typed_graph(spark):
    found = [("Buck Converter", "USES", "Inductor", 0.7), ("buck converter!", "USES", "inductor", 0.9), ("Inductor", "HAS_PROPERTY", "10 uH", 0.6), ("--", "USES", "x", 1.0), (None, "USES", "x", 1.0), ("x", None, "y", 1.0)]
    nodes, edges = N.typed_graph(spark.createDataFrame(found, "subject string, relation string, object string, confidence double"))
    assert {(r.id, r.label, r.confidence) for r in nodes.collect()} == {("design_recipe:buck_converter", "buck converter!", 0.9), ("component_type:inductor", "inductor", 0.9), ("electrical_property:10_uh", "10 uH", 0.6)}
    assert {(r.source_id, r.relation, r.target_id, r.confidence, r.layer) for r in edges.collect()} == {("design_recipe:buck_converter", "USES", "component_type:inductor", 0.9, 2), ("component_type:inductor", "HAS_PROPERTY", "electrical_property:10_uh", 0.6, 2)}


def test_datasheet_rules(spark):
    schema = "component_id string, part string, confidence double, pins array<struct<number:string,function:string>>, parameters array<struct<symbol:string,value:double,section:string>>, rules array<struct<kind:string,subject:string,relative_to:string,hard:boolean,distance_mm:double,confidence:double>>"
    sheets = spark.createDataFrame([("c1", "P1", 0.9, [("1", None)], [("Vn", 1.0, "EC"), ("Vn", 2.0, "EC"), (None, 3.0, None)], [("near", "C1", "U1", True, 2.0, 0.8), ("away", "C1", "U1", None, None, None)]), ("c2", None, 0.5, None, [], None)], schema)
    nodes, edges = G.datasheet_graph(sheets)
    got = {r.id: r for r in nodes.collect()}
    assert set(got) == {"component:c1", "component:c2", "pin:c1:1", "property:c1:Vn:EC", "property:c1:unknown:unknown", "placement_rule:c1:0", "placement_rule:c1:1"}
    assert got["property:c1:Vn:EC"].properties == {"symbol": "Vn", "value": "2.0", "section": "EC"} and got["component:c2"].properties == {"pin_count": "0"}
    first, second = got["placement_rule:c1:0"], got["placement_rule:c1:1"]
    assert (first.label, first.layer, first.confidence, second.confidence, second.properties) == ("near: C1 -> U1", 4, 0.8, 0.9, {"kind": "away", "subject": "C1", "relative_to": "U1"})
    assert {(r.relation, r.layer) for r in edges.collect()} == {("HAS_PIN", 3), ("HAS_PROPERTY", 3), ("GOVERNED_BY", 4)} and edges.count() == 5
    counts = {r.node_type: (r.created, r.updated) for r in G.import_counts(nodes, nodes.filter("layer = 4")).collect()}
    assert counts["PLACEMENT_RULE"] == (0, 2) and counts["PROPERTY"] == (2, 0)
    assert G.datasheet_graph(sheets.limit(0))[0].count() == 0


def test_split_bins(spark):
    """A third of the ranges in one bin: the same pairs however small the blocks are."""
    spans = [(i, float(i % 3 and i), float(i % 3 and i) + 1.5) for i in range(60)] + [(60, None, 2.0), (61, None, None)]
    rows = spark.createDataFrame(spans, "k int, lo double, hi double")
    whole = [(k, lo if lo is not None else hi, hi) for k, lo, hi in spans if hi is not None]
    want = {(a[0], b[0]) for a, b in combinations(whole, 2) if a[1] <= b[2] and b[1] <= a[2]}
    points = spark.createDataFrame([(i, i / 2) for i in range(-4, 140)] + [(999, None)], "p int, at double")
    held = {(i, k) for i in range(-4, 140) for k, lo, hi in spans if lo is not None and lo <= i / 2 <= hi}
    for block in (2, 10_000):
        pairs = J.overlapping_pairs(rows, "k", "lo", "hi", 2.0, block).collect()
        assert {tuple(r) for r in pairs} == want and len(pairs) == len(want)
        found = J.range_join(points, rows, "at", "lo", "hi", 2.0, block=block).select("p", "k").collect()
        assert {tuple(r) for r in found} == held and len(found) == len(held)


def test_split_nets(spark):
    """A ground net of all refs is paired in blocks; edges are those of brute force, once each."""
    on = [("d", "GND", "ground", f"U{i}") for i in range(25)] + [("d", "N1", None, f"U{i}") for i in range(4)] + [("d", "VCC", "power", f"U{i}") for i in range(2, 6)] + [("d", "GND", "ground", "U1")]
    nets = spark.createDataFrame(on, "design_id string, net_name string, net_type string, ref string")
    bom = spark.createDataFrame([("d", "U1", "LDO")], "design_id string, ref string, component_type string")
    want = {}
    for net in ("GND", "N1", "VCC"):
        refs = {(r, kind) for _, n, kind, r in on if n == net}
        for a, kind in refs:
            for b, _ in refs:
                if a != b:
                    p, g = want.get((a, b), (False, False))
                    want[a, b] = (p or kind == "power", g or kind == "ground")
    for block in (4, 10_000):
        vertices, edges = K.connections(nets, bom, block)
        got = edges.collect()
        assert {(r.ref, r.other): (r.power, r.ground) for r in got} == want and len(got) == len(want)
        assert vertices.count() == 25 and vertices.filter("kind = 'ldo'").count() == 1


def test_best_range_and_split_keys(spark):
    """The best range of each point against trying all; axioms and roles however small the parts are."""
    from fathomgrid.functions.blocks import matched

    spans = [(i, i % 7 * 10.0 - 20, i % 7 * 10.0 - 20 + (i % 5) ** 3, i % 3 if i % 4 else None) for i in range(60)] + [(60, 5.0, 4.0, 1), (61, None, 9.0, 1), (62, -1000.0, 1000.0, 9)]
    at = [(i, i / 3 - 30, i % 4 if i % 5 else None) for i in range(400)] + [(400, None, 1), (401, 5000.0, 1)]
    points = spark.createDataFrame(at, "p int, at double, kind int")
    ranges = spark.createDataFrame(spans, "r int, lo double, hi double, kind int")
    held = {p: min((k != kind, r) for r, lo, hi, k in spans if lo is not None and lo <= x <= hi) for p, x, kind in at if x is not None and x <= 1000}
    for width in (2.0, 700.0, 100_000.0):
        found = J.best_range(points, ranges, "p", "at", "lo", "hi", "kind", "r", width, block=3).collect()
        assert {r.p: (not r.same_kind, r.r) for r in found} == held and len(found) == len(held)

    axioms = [(i, f"x{i % 2}", ("Abcab", "bcabA", "zz", "abc")[i % 4]) for i in range(23)] + [(23, None, "zz"), (24, "x0", None)]
    ratio = lambda a, b: 2 * matched(a.lower(), b.lower()) / (len(a) + len(b))
    want = sorted((a, b) for (a, m, s), (b, n, t) in combinations(axioms, 2) if m and s and t and m == n and ratio(s, t) < 0.6)
    held = spark.createDataFrame(axioms, "axiom_id int, implication string, requirement string")
    roles = spark.createDataFrame([(i, "r", None, 1) for i in range(30)] + [(30, "r", "p1", 1), (31, "r", None, None)], "pattern_id int, role string, part string, category int")
    parts = spark.createDataFrame([(1, "p1", 2), (2, "p2", 1), (3, None, None)], "component_id int, part string, category int")
    for block in (2, 1000):
        assert sorted((r.a, r.b) for r in N.axiom_conflicts(held, block=block).collect()) == want
        assert sorted((r.pattern_id, r.component_id, r.score) for r in N.role_candidates(roles, parts, block).collect()) == [(i, 2, 0.8) for i in range(30)] + [(30, 1, 1.0)]


def test_parts_of_sheets_are_dealt_by_their_number(spark, monkeypatch):
    """More parts get more tasks, so that a task's memory doesn't grow with the sheets."""
    from fathomgrid.operators import graph as G

    monkeypatch.setattr(G, "PART_ROWS", 10)
    sheets = spark.createDataFrame([(str(i), "P", 0.9, [(str(j), "f") for j in range(10)], None) for i in range(20)], "component_id string, part string, confidence double, pins array<struct<number string, function string>>, parameters array<struct<symbol string, value double, section string>>")
    nodes, edges = G.datasheet_graph(sheets)
    assert (nodes.count(), edges.count()) == (220, 200)
    assert nodes.rdd.getNumPartitions() == edges.rdd.getNumPartitions() == 22


def test_patterns_of_designs_in_a_row_and_by_joins(spark):
    """A design put into one row gives what joins of its edges give, whatever its size; null ids, refs and types, refs of two types, nets of two types."""
    rng = random.Random(5)
    types = ["LDO", "resistor", "capacitor", "op_amp", "buck", "inductor", None]
    pins, bom = [], []
    for d in range(200):
        refs = [f"U{i}" for i in range(rng.randint(1, 12))]
        design = None if d == 0 else f"d{d}"
        for n in range(rng.randint(1, 7)):
            pins += [(design, f"N{n}" if rng.random() < 0.97 else None, rng.choice(["power", "signal", "ground", None]) if rng.random() < 0.2 else ["power", "signal", "ground"][n % 3], r if rng.random() < 0.97 else None) for r in refs if rng.random() < 0.3]
        bom += [(design, r, rng.choice(types)) for r in refs for _ in range(rng.choice([0, 1, 1, 1, 2]))]
    nets = spark.createDataFrame(pins, "design_id string, net_name string, net_type string, ref string")
    parts = spark.createDataFrame(bom, "design_id string, ref string, component_type string")
    seen = lambda most: sorted((str(r.design_id), r.n, tuple(sorted(r.asked)), tuple(sorted(r.found))) for r in K.patterns_in(nets, parts, tuple(K.PATTERNS), most).collect() if r.design_id is not None)
    row = seen(64)
    assert row == seen(0) == seen(12)
    assert {name for r in row for name in r[3]} >= {"ldo", "voltage_divider", "rc_lowpass", "current_source"}
    by_row, by_joins = (K.topology_checks(nets, parts, most=most) for most in (64, 0))
    for one, other in zip(by_row, by_joins, strict=True):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_small_designs_need_no_edges(spark, monkeypatch):
    """Edges, joined again for each pair of a pattern, are made for large designs only."""
    made = []
    monkeypatch.setattr(K, "connections", lambda *tables, of=K.connections: made.append(1) or of(*tables))
    nets = spark.createDataFrame([("d", "N", "power", "A"), ("d", "N", "power", "B"), ("d", "M", "signal", "A")], "design_id string, net_name string, net_type string, ref string")
    bom = spark.createDataFrame([("d", "A", "LDO"), ("e", "A", "Resistor")], "design_id string, ref string, component_type string")
    violations, checked = K.topology_checks(nets, bom, ("ldo", "rc_lowpass"))
    assert sorted((r.design_id, r.rule, r.subject) for r in violations.collect()) == [("d", "topology_too_small", "ldo"), ("e", "topology_too_small", "rc_lowpass")]
    assert sorted(tuple(r) for r in checked.collect()) == [("d", 1), ("e", 1)]
    assert not made


def test_pairs_of_members_travel_in_arrays(spark):
    members = spark.createDataFrame([(g, k) for g in "xyz" for k in range(20)] + [("x", 3)], "g string, k int")
    pairs = spark.createDataFrame([("x", "y", 1), ("z", "z", 2)], "g_a string, g_b string, n int")
    of = {g: [r.k for r in members.collect() if r.g == g] for g in "xyz"}
    want = sorted((n, a, b) for x, y, n in (("x", "y", 1), ("z", "z", 2)) for a in of[x] for b in of[y])
    for block, piece in ((1_000, 64), (7, 3), (1, 1)):
        found = J.member_pairs(pairs, members, [], "g", "k", block, piece)
        assert sorted((r.n, r.k_a, r.k_b) for r in found.collect()) == want
    rows = spark.createDataFrame([(k, k % 3, k % 3 + 1) for k in range(50)], "k int, lo int, hi int")
    axioms = spark.createDataFrame([(k, "i", text) for k, text in enumerate(("abc", "xyz", "uvw", "abd"))], "axiom_id int, implication string, requirement string")
    for made in (J.overlapping_pairs(rows, "k", "lo", "hi", 2.0), N.axiom_conflicts(axioms)):
        assert made.rdd.getNumPartitions() == 4  # tasks that read little aren't joined to one: they make much
    assert {r.ratio for r in N.axiom_conflicts(spark.createDataFrame([(1, "i", "abcdefg"), (2, "i", "xyza")], axioms.schema), digits=2).collect()} == {0.18}


def test_ranges_that_repeat(spark):
    """Points meet distinct ranges, by key too; rows of a range, with nulls and repeats, follow in parts however small."""
    spans = [(i if i % 5 else None, i % 2, i % 4 * 10.0, i % 4 * 10.0 + 7, "n" if i % 3 else None) for i in range(40)] + [(1, 1, 10.0, 17.0, "n"), (2, None, 0.0, 90.0, "n"), (3, 1, 9.0, 8.0, "n"), (4, 0, 0.0, 31.0, "n")]
    at = [(i, i % 2 if i % 7 else None, i / 2 - 20) for i in range(200)] + [(200, 1, None), (201, 1, 1e9)]
    points = spark.createDataFrame(at, "p int, g int, at double")
    ranges = spark.createDataFrame(spans, "k int, g int, lo double, hi double, name string")
    held = lambda g: sorted(((p, k, lo, hi, n) for p, a, x in at for k, b, lo, hi, n in spans if x is not None and lo <= x <= hi and (not g or a == b is not None)), key=repr)
    for width, block in ((5.0, 2), (1e-3, 3), (200.0, 10_000)):
        whole = J.range_join(points, ranges.withColumnRenamed("g", "h"), "at", "lo", "hi", width, block=block).select("p", "k", "lo", "hi", "name")
        assert sorted(map(tuple, whole.collect()), key=repr) == held(False)
        keyed = J.range_join(points, ranges, "at", "lo", "hi", width, ["g"], block).select("p", "k", "lo", "hi", "name")
        assert sorted(map(tuple, keyed.collect()), key=repr) == held(True)
    ends = J.range_join(points.select("p", "at"), ranges.select("lo", "hi"), "at", "lo", "hi", 5.0)
    assert ends.count() == len(held(False)) and ends.columns == ["p", "at", "lo", "hi"]
    assert whole.rdd.getNumPartitions() == 4  # tasks that read little aren't joined to one: they make much
