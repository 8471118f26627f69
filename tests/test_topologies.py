"""The topology library and the way of changes through its laws."""

from fathomgrid.operators.topologies import BLOCKS, LAWS, influences, laws, topology_graph


def test_library(spark):
    nodes, edges = topology_graph(spark)
    assert nodes.count() == 11 and edges.count() == 9 and {(t, b) for t, b, *_ in LAWS} <= {(t, b) for t, b, *_ in BLOCKS}
    assert sum(len(r.laws or []) for r in edges.collect()) == len(LAWS)


def test_influences(spark):
    own = [("t", "a", "b", 1, None), ("t", "b", "c", -1, None), ("t", "c", "a", 1, None), ("t", "a", "d", 1, "hot"), ("u", "a", "z", 1, None)]
    law = spark.createDataFrame(own, "topology string, parameter string, affects string, sign int, condition string")
    changes = [("1", "t", "a", 1, ["hot", "x"]), ("1", "t", "a", 1, None), ("2", "t", "b", -1, None), ("3", "u", "a", -1, []), ("4", "t", "q", 1, None), ("5", "t", None, 1, None), ("6", "t", "a", 0, None)]
    got = influences(spark.createDataFrame(changes, "design_id string, topology string, quantity string, sign int, conditions array<string>"), law)
    rows = {(r.design_id, r.quantity): (r.direction, r.steps) for r in got.collect()}
    assert rows[("1", "a")] == ("both", 0) and rows[("1", "d")] == ("both", 1) and rows[("1", "b")] == ("both", 1)
    assert rows[("2", "b")] == ("both", 0) and rows[("2", "a")] == ("both", 2) and ("2", "d") not in rows
    assert {k: v for k, v in rows.items() if k[0] > "2"} == {("3", "a"): ("down", 0), ("3", "z"): ("down", 1), ("4", "q"): ("up", 0)}
    one = spark.createDataFrame([("x", "buck_converter", "switching_frequency_hz", 1, None)], "design_id string, topology string, quantity string, sign int, conditions array<string>")
    assert {(r.quantity, r.direction) for r in influences(one, laws(spark)).collect()} == {("switching_frequency_hz", "up"), ("loop_area_mm2", "down"), ("switching_loss_w", "up"), ("inductance_uh", "down")}
    assert influences(one.limit(0), laws(spark)).count() == 0
