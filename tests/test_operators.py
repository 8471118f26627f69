"""Operators over small domain fixtures."""

import pytest
from pyspark.sql import functions as F

from fathomgrid.operators import aggregates as A
from fathomgrid.operators import graph as G
from fathomgrid.operators import joins as J
from fathomgrid.operators import parametric as P
from fathomgrid.operators import ranking as R
from fathomgrid.operators import relational as L
from fathomgrid.operators import retrieval as V
from fathomgrid.operators import rules as K
from fathomgrid.operators import search as S
from fathomgrid.operators import synthesis as N
from fathomgrid.operators.beam import beam
from fathomgrid.operators.topologies import topology_graph


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_comparisons():
    assert [P.comparison(x) for x in ("<=3", ">= 2", "==1", "<0.5", ">9", " 7 ", "inverting", "")] == [("<=", 3.0), (">=", 2.0), ("==", 1.0), ("<", 0.5), (">", 9.0), ("==", 7.0), None, None]
    assert P.symbol_of("psrr_dB") == ("PSRR", "value_min") and P.symbol_of("else") == ("else", "value_typ")


def test_parametric_skips_words_and_keeps_order(spark):
    parts = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "component_id int, name string")
    facts = spark.createDataFrame([(1, 1, "Vn", 5.0), (2, 2, "Vn", 50.0), (3, 3, "Vn", 9.0)], "component_id int, parameter_id int, symbol string, value_typ double").selectExpr("*", "value_typ AS value_min", "value_typ AS value_max")
    found = P.parametric_search(parts, facts, {"noise_uVrms": "<10", "type": "inverting"})
    assert [r.component_id for r in found.collect()] == [1, 3]


def test_axioms_are_false_when_unknown_or_null(spark):
    df = spark.createDataFrame([(1, "dc", ["bypass cap"]), (2, None, None)], "n int, kind string, notes array<string>")
    of = lambda rule: [r.n for r in df.filter(P.axiom(rule, df.columns)).collect()]
    assert of("kind == dc") == [1] and of("n >= 2") == [2] and of("notes contains BYPASS") == [1]
    assert of("kind < dc") == [] and of("gone == 1") == [] and of({"all_of": ["n >= 1", "kind == dc"]}) == [1] and of({"any_of": ["n == 2", "kind == dc"]}) == [1, 2] and of({"none": []}) == []


def test_freshness_and_store(spark):
    schema = "url string, etag string, content_length long, head_hash string"
    seen = spark.createDataFrame([("a", "1", 5, "x"), ("b", None, 5, "x"), ("c", None, None, "x"), ("d", "1", 1, "x")], schema)
    now = spark.createDataFrame([("a", "1", 9, "y"), ("b", "2", 6, "x"), ("c", None, None, "x"), ("e", "1", 1, "x")], schema)
    assert rows(L.freshness(now, seen, "url"), "url", "changed") == [("a", False), ("b", True), ("c", False), ("e", True)]


def test_tree_ignores_cycles(spark):
    nodes = spark.createDataFrame([("r", None, "root"), ("a", "r", "A"), ("x", "y", "X"), ("y", "x", "Y")], "id string, parent string, name string")
    assert rows(L.tree_paths(nodes, "id", "parent", "name"), "id", "full_path", "depth") == [("a", "root/A", 1), ("r", "root", 0)]


def test_retrieval_helpers(spark):
    layers = spark.createDataFrame([(1, "kg", 1.0, 1), (1, "kg", 1.0, 2), (2, "kg", 1.0, 3)], "id int, layer string, layer_score double, rank int")
    twice, once = ({r.id: r.final_score for r in V.fuse(layers, "id", once=o).collect()} for o in (False, True))
    assert twice[1] == pytest.approx(1 / 61 + 1 / 62) and once[1] == pytest.approx(1 / 61)
    df = spark.createDataFrame([("low noise amp",), ("relay",)], "t string")
    assert [r.x for r in df.select(V.expand_query(F.col("t"), [["opamp", "amp"], ["switch", "relay"]]).alias("x")).collect()] == ["low noise amp opamp", "relay switch"]
    needs = spark.createDataFrame([("d", 1, "low_noise_ldo", "HIGH", "r" * 200), ("d", 2, None, "LOW", ""), ("d", 3, "custom", "CRITICAL", "z"), ("d", 4, "pcb_layout_constraint", "HIGH", "")], "design_id string, pos int, implication string, priority string, requirement string")
    plan = V.plan_components(needs).orderBy("position").collect()
    assert [(r.component_type, len(r.source), r.required) for r in plan] == [("custom", 1, {}), ("low_noise_ldo", 100, {"noise_uVrms": "<10", "psrr_dB": ">60"})]
    topo = spark.createDataFrame([("d", "buck_boost", 0.9), ("d", "ldo", 0.5)], "design_id string, name string, confidence double")
    assert rows(V.plan_documents(topo), "search_term") == [("buck boost application note",), ("buck boost circuit design",)]


def test_joins(spark):
    pages = spark.createDataFrame([(1, "see (1) first note (2) second note"), (2, "none")], "page int, text string")
    found = J.definitions_of(pages)
    assert rows(found, "page", "marker", "body") == [(1, "1", "first note"), (1, "2", "second note")]
    marks = spark.createDataFrame([(1, "2"), (2, "1")], "page int, marker string")
    assert rows(J.footnotes(marks, found), "page", "marker", "body") == [(1, "2", "second note"), (2, "1", None)]
    inst = spark.createDataFrame([("i2", "LDO"), ("i1", "ldo"), ("i3", "cap")], "instance_id string, component_type string")
    types = spark.createDataFrame([("t1", "ldo"), ("t2", "coil"), ("t3", "gone")], "type_id string, label string")
    ruled = spark.createDataFrame([("t2", "i3"), ("t3", "i9")], "source_id string, target_id string")
    assert rows(J.resolve(inst, types, ruled), "type_id", "instance_id", "via") == [("t1", "i1", "property"), ("t2", "i3", "rule"), ("t3", None, None)]
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 3, 20.0, 20.0, 30.0, 30.0, 0.1), (2, 4, 0.0, 0.0, 10.0, 10.0, 0.2)], "page int, box_id int, x0 double, y0 double, x1 double, y1 double, confidence double")
    assert rows(J.keep_best_boxes(boxes, ["page"]), "box_id") == [(1,), (3,), (4,)]
    needs = spark.createDataFrame([("ovp",), ("esd",), ("uvlo",)], "slug string")
    blocks = spark.createDataFrame([("ovp", "b:1"), ("x", "block:esd")], "block_slug string, block_id string")
    assert rows(J.unresolved_requirements(needs, blocks), "slug") == [("uvlo",)]


def test_large_groups_are_split(spark):
    df = spark.range(60).selectExpr("id AS i", "CASE WHEN id < 40 THEN 1 ELSE id % 3 END AS g", "CAST(id % 7 AS DOUBLE) AS v")
    whole = rows(J.group_pairs(df, ["g"], "i"), "g", "i_a", "i_b")
    assert whole == rows(J.group_pairs(df, ["g"], "i", 8), "g", "i_a", "i_b") and len(whole) == len(set(whole)) > 40 * 39 // 2


def test_ranking(spark):
    cells = spark.createDataFrame([("g", 0, 0, "A"), ("g", 0, 1, "A"), ("g", 0, 2, ""), ("g", 0, 3, ""), ("g", 1, 0, None)], "grid_id string, row int, col int, text string")
    assert rows(R.merged_cells(cells), "row", "col", "colspan") == [(0, 0, 2), (0, 2, 1), (1, 0, 1)]
    tables = spark.createDataFrame([(1, 1, 0, 3, ["a"]), (1, 2, 0, 3, ["a"]), (1, 3, 0, 3, ["a"]), (1, 5, 0, 3, ["a"]), (1, 6, 0, 2, ["a"])], "doc_id long, page int, pos int, n_cols int, header array<string>")
    assert rows(R.continuations(tables), "page", "is_continuation") == [(1, False), (2, True), (3, True), (5, False), (6, False)]
    entries = spark.createDataFrame([("U1", 0, 0.9), ("U1", 1, 0.9), ("U1", 2, 0.9), ("U1", 3, 0.9)], "ref string, alt_rank int, confidence double")
    assert rows(R.ladder(entries, ["ref"]), "alt_rank", "variant_confidence") == [(0, 0.9), (1, 0.873), (2, 0.8468)]
    a, b = (spark.createDataFrame(x, "k string, score double") for x in ([("p", 0.5), ("q", None)], [("p", 0.5), ("q", 0.1)]))
    assert rows(R.better_of(a.withColumn("o", F.lit("a")), b.withColumn("o", F.lit("b")), ["k"], "score"), "k", "o") == [("p", "a"), ("q", "b")]


def test_aggregates(spark):
    bom = spark.createDataFrame([("d", "ldo_regulator", 0.9), ("d", "ceramic_capacitor", 0.5), ("d", "thing", 0.7)], "design_id string, component_type string, confidence double")
    assert rows(A.bom_confidence(bom), "score") == [(round((1.8 + 0.25 + 0.7) / 3.5, 4),)]
    maps = spark.createDataFrame([("d", 1, {"a": "1", "b": "1"}), ("d", 2, {"b": "2"})], "k string, pos int, m map<string,string>")
    assert A.merged_maps(maps, ["k"], "m", "pos").first().m == {"a": "1", "b": "2"}
    layers = spark.createDataFrame([("d", 1, 1.0), ("d", 5, 0.0)], "design_id string, layer int, score double")
    assert rows(A.layered_score(layers), "score") == [(0.875,)]
    assert rows(A.values_confidence(spark.createDataFrame([("c", 0.5, None), ("c", 1.0, 0.6)], "c string, a double, b double"), ["c"], ["a", "b"]), "confidence") == [(0.7,)]


EDGE = "source_id string, relation string, target_id string, confidence double"


def test_reach_prefers_confidence_then_source(spark):
    edges = spark.createDataFrame([("s", "USES", "a", 0.9), ("s", "USES", "b", 0.8), ("a", "USES", "c", 0.7), ("b", "USES", "c", 0.9), ("c", "USES", "s", 1.0), ("s", "OTHER", "z", 1.0), ("s", "USES", "w", 0.5), ("c", "PART_OF", "e", 1.0)], EDGE)
    visited, crossed = G.reach(edges, spark.createDataFrame([("s",)], "id string"), 2)
    assert [(i, d, round(c, 6)) for i, d, c in rows(visited, "id", "depth", "confidence")] == [("a", 1, 0.9), ("b", 1, 0.8), ("c", 2, 0.72), ("s", 0, 1.0)]
    assert ("b", "c") in rows(crossed, "source_id", "target_id")
    assert G.reach(edges, spark.createDataFrame([("nowhere",)], "id string"))[0].count() == 1


def test_graph_changes(spark, tmp_path):
    schema = "id string, node_type string, label string, layer int, confidence double, v int"
    nodes = spark.createDataFrame([("topology:buck", "TOPOLOGY", "buck converter", 1, 1.0, 1), ("block:l", "BLOCK", "Power inductor", 2, 1.0, 1), ("x", "BLOCK", " ", 9, 2.0, 1)], schema)
    changed = G.upsert_nodes(nodes, spark.createDataFrame([("x", "BLOCK", "named", 2, 0.5, 2)], schema), "v")
    assert {r.label for r in changed.collect()} == {"buck converter", "Power inductor", "named"}
    edges = spark.createDataFrame([("block:l", "PART_OF", "topology:buck", 0.9, 1), ("block:l", "USES", "topology:buck", 0.8, 0)], EDGE + ", v int")
    merged, refused = G.upsert_edges(edges, spark.createDataFrame([("x", "USES", "gone", 1.0, 5), ("x", "USES", "block:l", 1.0, 5)], EDGE + ", v int"), nodes, "v")
    assert rows(merged, "source_id", "relation") == [("block:l", "PART_OF"), ("x", "USES")] and rows(refused, "target_id") == [("gone",)]
    assert rows(G.start_nodes(nodes, edges, spark.createDataFrame([("buck",)], "slug string")), "id") == [("block:l",), ("topology:buck",)]
    assert rows(G.match_goal(nodes, "buck_converter"), "id", "tier") == [("topology:buck", 1)] and rows(G.match_goal(nodes, "some inductor"), "id", "tier") == [("block:l", 3)]
    assert rows(G.integrity(nodes, edges), "problem", "key") == [("blank_label", "x"), ("node_confidence", "x")]
    assert rows(G.layer_stats(nodes), "layer", "n") == [(1, 1), (2, 1), (3, 0), (4, 0), (5, 0)]
    sheets = spark.createDataFrame([("c1", "P1", 0.9, [("1", "VDD")], [("Vn", 1.0, "EC"), ("Vn", 2.0, "EC"), (None, 3.0, "EC")])], "component_id string, part string, confidence double, pins array<struct<number:string,function:string>>, parameters array<struct<symbol:string,value:double,section:string>>")
    made, links = G.datasheet_graph(sheets)
    assert made.count() == 4 and links.count() == 3


NETS = "design_id string, net_name string, net_type string, ref string, pin_number string"
PINS = "design_id string, ref string, pin_number string, pin_type string, function string, role string"


def fixture(spark):
    nets = spark.createDataFrame([("d", "VCC_3V3_5V", "power", "U1", "1"), ("d", "VCC_3V3_5V", "power", "U2", "1"), ("d", "SIG", "signal", "U1", "2"), ("d", "SIG", "signal", "U2", "2"), ("d", "IN", "signal", "U2", "3"), ("d", "NCNET", "signal", "U1", "5"), ("d", "NCNET", "signal", "U2", "6")], NETS)
    pins = spark.createDataFrame([("d", "U1", "1", "power", None, "POWER_IN"), ("d", "U2", "1", "power", None, "POWER_IN"), ("d", "U1", "2", "output", None, "SIGNAL_OUT"), ("d", "U2", "2", "output", None, "SIGNAL_OUT"), ("d", "U2", "3", "input", None, "SIGNAL_IN"), ("d", "U1", "4", "power", "POWER_GROUND", "GROUND"), ("d", "U1", "5", "nc", None, "NC"), ("d", "U2", "6", "input", "POWER_INPUT", None)], PINS)
    return nets, pins


def test_rules(spark):
    nets, pins = fixture(spark)
    assert rows(K.electrical_checks(nets, pins), "rule", "subject") == [("no_floating_inputs", "IN"), ("no_logic_level_mismatch", "VCC_3V3_5V"), ("no_output_conflict", "SIG"), ("no_required_pin_floating", "U1.4"), ("power_net_has_source", "VCC_3V3_5V")]
    found, checked = K.role_checks(nets, pins)
    assert rows(found, "rule", "subject") == [("driver_conflict", "SIG:SIGNAL_OUT"), ("nc_connected", "U1.5"), ("power_undriven", "VCC_3V3_5V")]
    assert rows(K.scores(found, checked), "checked", "critical", "warning", "score") == [(9, 2, 1, round(6.5 / 9, 4))]
    bom = spark.createDataFrame([("d", "U1", "opamp"), ("d", "U2", "plain")], "design_id string, ref string, component_type string")
    found, checked = K.template_checks(nets, pins, bom)
    assert rows(found, "rule") == [] and rows(checked, "checked") == [(2,)]
    found, _ = K.template_checks(nets, pins, bom.withColumn("component_type", F.lit("ldo")))
    assert rows(found, "rule", "subject") == [("role_missing", "U1:POWER_OUT"), ("role_missing", "U2:GROUND"), ("role_missing", "U2:POWER_OUT"), ("role_unconnected", "U1:GROUND")]


def test_ground_rules(spark):
    nets = spark.createDataFrame([("d", f"G{i}", "power", "U1", str(i)) for i in range(4)] + [("d", "OUT", "power", "U1", "s"), ("d", "OUT", "power", "U1", "o"), ("d", "G0", "power", "U2", "g")], NETS)
    pins = spark.createDataFrame([("d", "U1", str(i), "", None, "GROUND") for i in range(4)] + [("d", "U1", "s", "", None, "SENSE_POS"), ("d", "U1", "o", "", None, "POWER_OUT"), ("d", "U2", "g", "", None, "GROUND")], PINS)
    bom = spark.createDataFrame([("d", "U1", "adc"), ("d", "U2", "mcu")], "design_id string, ref string, component_type string")
    assert rows(K.ground_checks(nets, pins, bom), "rule", "subject") == [("kelvin_short", "OUT"), ("many_grounds", "4"), ("shared_ground", "G0")]


def test_netlist_and_bom_rules(spark):
    comps = spark.createDataFrame([("d", "U1", 0.0), ("d", "U2", 0.9)], "design_id string, ref string, datasheet_confidence double")
    nets = spark.createDataFrame([("d", "P", "power", "U1", "1", "X"), ("d", "S", "signal", "U9", "1", "A"), ("d", "Q", "power", "U1", "2", "VOUT"), ("d", "Q", "power", "U2", "2", "VCC")], NETS + ", pin_name string")
    places = spark.createDataFrame([("d", "U7"), ("d", "U1")], "design_id string, ref string")
    assert rows(K.netlist_checks(comps, nets, places), "rule", "subject") == [("power_with_many_sources", "Q"), ("power_without_source", "P"), ("single_pin_net", "S"), ("unknown_net_ref", "S"), ("unknown_placement_ref", "U7"), ("zero_confidence", "U1")]
    bom = spark.createDataFrame([("d", 1, "U1", "ldo", "A", {"output_voltage": "3.3"}, 0.9), ("d", 2, "U2", "ldo", "B", {"output_voltage": "5"}, 0.9), ("d", 3, "U3", "ldo", None, {"output_voltage": "adj"}, 0.7)], "design_id string, pos int, ref string, component_type string, part string, constraints map<string,string>, confidence double")
    cache = spark.createDataFrame([("A", "obsolete")], "part string, status string")
    assert rows(K.bom_checks(bom, cache, F.col("component_type") == "ldo", F.lit(False)), "rule", "subject") == [("not_available", "A"), ("voltage_conflict", "U1/U2")]
    scored = spark.createDataFrame([("d", 0.99), ("e", 0.5), ("f", 0.99)], "design_id string, score double")
    assert rows(K.bom_review(bom, scored), "design_id", "review") == [("d", True), ("e", True), ("f", False)]


def test_parameter_rules(spark):
    schema = "component_id int, parameter_name string, symbol string, value_min double, value_typ double, value_max double, confidence double"
    rowset = [(1, "VIL", "V_IL", None, None, 2.0, 0.9), (1, "VIH", "V_IH", 1.5, None, None, 0.9), (1, "bad", "x", 3.0, None, 1.0, 0.9), (2, "Vcc max", "V_CC", None, None, 99.0, 0.2)]
    p = spark.createDataFrame(rowset, schema)
    assert rows(K.cross_checks(p), "component_id", "rule") == [(1, "vil_below_vih")]
    assert rows(K.ordering_problems(p), "parameter_name", "problem") == [("bad", "min_above_max")]
    gate = {r.component_id: r for r in K.quality_gate(p).collect()}
    assert gate[1].failed == ["bad"] and gate[2].low_confidence == ["Vcc max"] and gate[2].warnings == ["Vcc max"] and not gate[2].passed
    limit = spark.createDataFrame([(2, "VCC", "V_CC", None, None, 60.0, 1.0)], schema)
    assert rows(K.limits_exceeded(p, limit), "operating_max", "absolute_max") == [(99.0, 60.0)]


PART = "design_id string, ref string, pin_number string, pin_name string, function string, confidence double, part_text string"


def test_synthesis(spark):
    pins = spark.createDataFrame([("d", "U1", "1", "", "POWER_POSITIVE", 0.8, "3.3V ldo"), ("d", "U2", "1", "", "POWER_POSITIVE", None, "5V buck"), ("d", "U3", "1", "", "POWER_GROUND", 1.0, "mcu"), ("d", "U3", "2", "", "SPI_CLOCK", 1.0, "mcu"), ("d", "U4", "2", "", "SPI_CLOCK", 0.5, "adc"), ("d", "U4", "3", "", "SPI_CHIP_SELECT", 1.0, "adc"), ("d", "U3", "4", "", "UART_TRANSMIT", 1.0, "mcu"), ("d", "U3", "5", "", "UART_RECEIVE", 1.0, "mcu"), ("d", "U5", "5", "", "UART_RECEIVE", 1.0, "gps"), ("d", "C1", "1", "", None, 1.0, "cap"), ("d", "C1", "2", "", None, 1.0, "cap")], PART)
    power, signal = N.power_nets(pins), N.signal_nets(pins)
    assert rows(power, "net_name", "ref") == [("GND", "U3"), ("VCC_3p3V", "U1"), ("VCC_5V", "U2")]
    assert rows(signal, "net_name", "net_type", "ref") == [("SPI_CS_U4", "signal", "U4"), ("SPI_SCK", "clock", "U3"), ("SPI_SCK", "clock", "U4"), ("UART_U3_U5", "signal", "U3"), ("UART_U3_U5", "signal", "U5")]
    assert ("SPI_SCK", 0.75) in rows(N.net_confidence(signal), "net_name", "net_confidence") and ("VCC_5V", 0.5) in rows(N.net_confidence(power), "net_name", "net_confidence")
    bom = spark.createDataFrame([("d", "C1", "bypass_capacitor", "for U1 supply"), ("d", "U3", "mcu", ""), ("d", "U4", "adc", ""), ("d", "U5", "gps", "")], "design_id string, ref string, component_type string, justification string")
    made, open_ = N.passive_nets(bom, pins, power.unionByName(signal))
    assert rows(made, "net_name", "pin_number") == [("VCC_U1_BYPASS", "1"), ("VCC_U1_BYPASS_GND", "2")] and ("U3",) in rows(open_, "ref")
    assert rows(N.blocks(bom, signal), "block_type", "refs", "isolation") == [("analog", ["U4"], True), ("digital", ["U3", "U5"], False), ("passive", ["C1"], False)]
    hints = N.routing_hints(signal, spark.createDataFrame([("d", "FR4")], "design_id string, material string"))
    assert rows(hints, "net_name", "hint") == [("SPI_SCK", "isolation")]
    flags = spark.createDataFrame([("d", "U3", "b"), ("d", "U3", "a")], "design_id string, ref string, flag string")
    full = N.assemble(bom.withColumn("part", F.lit("P")).filter("ref = 'U3'"), spark.createDataFrame([], "part string, footprint string, datasheet_confidence double"), flags).first()
    assert (full.footprint, full.datasheet_confidence, full.flags) == ("UNKNOWN", 0.0, ["a", "b"])


def test_searches_repair_what_they_can(spark):
    pins = spark.createDataFrame([("d", "N", "U1", "1", "SIGNAL_OUT"), ("d", "N", "U2", "1", "SIGNAL_OUT"), ("d", "N", "U3", "1", "NC"), ("e", "M", "U1", "1", None)], "design_id string, net string, ref string, pin string, role string")
    assert rows(S.qualities(pins), "design_id", "score") == [("d", 0.0), ("e", 1.0)]
    for how in (S.anneal, beam):
        assert rows(S.qualities(how(pins)), "design_id", "score") == [("d", 1.0), ("e", 1.0)]
        assert rows(how(pins), "net") == rows(how(pins), "net")


def test_interval_and_verdict(spark):
    df = spark.createDataFrame([("a", "ldo", 3.4, 3.3, 100.0, 500.0), ("b", "buck_converter", 5.0, 3.3, 1000.0, 500.0), ("c", "boost", 1.0, 5.0, None, 1.0)], "design_id string, topology string, supply_max_v double, output_v double, output_ma double, budget_mw double")
    assert rows(K.interval_conflicts(df), "design_id", "conflicts") == [("a", ["voltage_chain"]), ("b", ["power_budget"]), ("c", [])]
    v = spark.createDataFrame([(0.2, []), (0.6, []), (0.9, ["x"]), (0.9, [])], "c double, f array<string>")
    assert [r.x for r in v.select(K.verdict(F.col("c"), F.col("f")).alias("x")).collect()] == ["BLOCK", "WARN", "WARN", "PASS"]


def test_knowledge(spark, tmp_path):
    from fathomgrid.operators import knowledge as W

    nodes, edges = topology_graph(spark)
    assert nodes.filter("node_type = 'TOPOLOGY'").count() == 2 and edges.count() == nodes.count() - 2
    boards = W.board_of(spark.createDataFrame([("a", "RF_highfreq"), ("b", "unheard")], "design_id string, methodology string"), spark)
    assert rows(boards, "design_id", "layers", "material") == [("a", 4, "Rogers_4003C"), ("b", 2, "FR4")]
    rules = spark.createDataFrame([("C1", "U1", "near", 0.9), ("", "U1", "near", 0.9), ("C2", "U1", "near", 0.1)], "subject string, target string, kind string, confidence double")
    made, links = W.placement_graph(rules, spark.createDataFrame([("u1",)], "id string"))
    assert rows(made, "node_type") == [("COMPONENT_TYPE",), ("PLACEMENT_RULE",)] and rows(links, "source_id", "relation") == [("c1", "GOVERNED_BY")]
    intents = spark.createDataFrame([("d", None, (5.0, None), None)], "design_id string, scope string, electrical struct<vin:double,vout:double>, thermal struct<t:double>")
    made = W.constraint_nodes(intents, {"electrical": "electrical", "thermal": "thermal"})
    assert rows(made, "id") == [("constraint:d:electrical:global",)] and made.first().properties == {"vin": "5.0"}
    phases = spark.createDataFrame([("r", p, i) for i, p in enumerate("abc")], "run_id string, phase string, pos int")
    assert rows(W.phases_to_run(phases, spark.createDataFrame([("r", "a"), ("r", "c")], "run_id string, phase string")), "phase") == [("b",), ("c",)]
    labels = spark.createDataFrame([("3.3 V",), ("buck converter",), ("coil",)], "t string")
    assert [r.x for r in labels.select(W.node_kind(F.col("t")).alias("x")).collect()] == ["PROPERTY", "DESIGN_PATTERN", "COMPONENT_TYPE"]
    head = spark.createDataFrame([("TPS62933 in SOT-23-5, 3.8V to 30V",)], "t string").select(W.header_fields(F.col("t")).alias("h")).first().h
    assert (head.part, head.package, head.supply) == ("TPS62933", "SOT-23-5", "3.8V to 30V")
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="a"><data key="k">{"x": "1"}</data></node><node id="b"><data key="k">oops</data></node><edge source="a" target="b"><data key="k">{"w": "2"}</data></edge></graph></graphml>')
    assert rows(W.graphml(spark, str(tmp_path), "node").select("id", F.try_element_at("properties", F.lit("x")).alias("x")), "id", "x") == [("a", "1"), ("b", None)]
    assert rows(W.graphml(spark, str(tmp_path), "edge"), "source", "target") == [("a", "b")]


def test_grids_and_ranges(spark):
    g = spark.createDataFrame([("t", 2, 0.5, "PINOUT", False), ("t", 1, 1.0, "OTHER", True), ("t", 3, 0.9, "TIMING", False)], "k string, pos int, confidence double, section string, from_model boolean")
    assert rows(A.merged_grids(g, ["k"], "pos"), "confidence", "section", "from_model") == [(0.8, "PINOUT", True)]
    tied = spark.createDataFrame([("t", 1, i, c, s, False) for i, c, s in ((0, 0.1, "PINOUT"), (1, 0.2, "TIMING"), (2, 0.3, "OTHER"))], "k string, pos int, row int, confidence double, section string, from_model boolean")
    for order in (["row"], [F.desc("row")]):
        assert rows(A.merged_grids(tied.repartition(3, "row").sort(*order), ["k"], "pos", ["row"]), "confidence", "section") == [(0.2, "PINOUT")]
    parts = spark.createDataFrame([(1,)], "component_id int")
    facts = spark.createDataFrame([(1, 7, row, "en", float(row)) for row in (3, 2, 4)], "component_id int, parameter_id int, row int, symbol string, value_typ double")
    for some in (facts, facts.sort("row"), facts.sort(F.desc("row"))):
        assert P.matched_attributes(parts, some, ["noise_nV_rtHz"], order=("parameter_id", "row")).first().matched == {"noise_nV_rtHz": 2.0}
    a = spark.createDataFrame([("d", 0.5)], "design_id string, confidence double")
    assert rows(A.mean_of_both(a, a.withColumn("confidence", F.lit(1.0))), "confidence") == [(0.75,)]
    assert [round(r.x, 3) for r in a.select(A.extraction_confidence(F.lit(0.97), F.lit(0.95), F.lit(0.88)).alias("x")).collect()] == [0.937]
    p = spark.createDataFrame([("Supply Voltage", None, 99.0, None), ("supply current", 1.0, None, None), ("gain", 1e9, None, None)], "name string, value_min double, value_typ double, value_max double")
    r = spark.createDataFrame([(1, "supply voltage", 0.0, 60.0), (2, "supply", 0.0, 5.0)], "pos int, pattern string, low double, high double")
    assert rows(K.out_of_range(p.union(p), r), "name", "high") == [("Supply Voltage", 60.0)] * 2 and K.out_of_range(p, r.limit(0)).count() == 0
    c = spark.createDataFrame([("C1", 0.9), (" ", 0.9), ("C2", 0.2)], "subject string, confidence double")
    assert rows(K.placement_problems(c), "problem") == [("low_confidence",), ("no_subject",)]


def test_merged_grids_add_up_exactly(spark):
    fiftieths = [24, 39, 7, 5, 16, 30, 2, 27, 24, 1, 26, 19, 28, 36, 7, 14]  # their mean lies between two roundings; doubles add up to less in this order
    g = spark.createDataFrame([("t", i, n / 50, "OTHER", False) for i, n in enumerate(fiftieths)], "k string, pos int, confidence double, section string, from_model boolean")
    for order in (["pos"], [F.desc("pos")]):
        assert rows(A.merged_grids(g.repartition(3, "pos").sort(*order), ["k"], "pos", ["pos"]), "confidence") == [(0.3813,)]
    odd = spark.createDataFrame([("a", 1, None), ("a", 2, 0.5), ("b", 1, 1e12), ("b", 2, 0.0), ("c", 1, float("inf")), ("c", 2, 0.5), ("d", 1, None)], "k string, pos int, confidence double")
    odd = odd.select("*", F.lit("OTHER").alias("section"), F.lit(False).alias("from_model"))
    assert sorted(rows(A.merged_grids(odd, ["k"], "pos"), "k", "confidence")) == [("a", 0.5), ("b", 5e11), ("c", float("inf")), ("d", None)]
