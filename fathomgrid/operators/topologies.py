"""The topology library: blocks, scaling laws, and what a change of a design's quantities does to its others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.session import written

#: Topologies, their labels, and their blocks with the quantities that a block depends on.
TOPOLOGIES = {"ldo": "LDO Regulator", "buck_converter": "Buck Converter"}
BLOCKS = (
    ("ldo", "input_cap", "Input Capacitor", ("supply_impedance_ohm", "transient_load_step_a")),
    ("ldo", "pass_element", "Pass Element", ("dropout_voltage_v", "output_current_a")),
    ("ldo", "output_cap", "Output Capacitor", ("load_transient_a", "esr_ohm")),
    ("ldo", "feedback", "Feedback Divider", ("output_voltage_v", "reference_voltage_v")),
    ("buck_converter", "switching_loop", "Switching Loop", ("switching_frequency_hz", "input_voltage_v")),
    ("buck_converter", "feedback_divider", "Feedback Divider", ("output_voltage_v", "reference_voltage_v")),
    ("buck_converter", "compensation_network", "Compensation Network", ("output_cap_esr_ohm", "crossover_frequency_hz")),
    ("buck_converter", "bootstrap_circuit", "Bootstrap Circuit", ("switching_frequency_hz", "gate_charge_nc")),
    ("buck_converter", "output_filter", "Output Filter", ("ripple_budget_mv", "switching_frequency_hz")),
)

#: Topology, block, parameter, quantity that it affects, 1 in proportion and -1 inversely, and when the law holds.
LAWS = (
    ("ldo", "input_cap", "transient_load_step_a", "capacitance_uf", 1, None),
    ("ldo", "pass_element", "output_current_a", "power_dissipation_w", 1, None),
    ("ldo", "pass_element", "dropout_voltage_v", "die_area_mm2", -1, None),
    ("ldo", "output_cap", "esr_ohm", "loop_stability_margin_deg", 1, "ESR-zero-compensated LDO"),
    ("ldo", "feedback", "divider_impedance_ohm", "output_noise_uvrms", 1, None),
    ("buck_converter", "switching_loop", "switching_frequency_hz", "loop_area_mm2", -1, None),
    ("buck_converter", "switching_loop", "switching_frequency_hz", "switching_loss_w", 1, None),
    ("buck_converter", "feedback_divider", "divider_impedance_ohm", "quiescent_current_ua", -1, None),
    ("buck_converter", "compensation_network", "output_cap_esr_ohm", "component_count", 1, "voltage-mode control"),
    ("buck_converter", "compensation_network", "crossover_frequency_hz", "transient_response_us", -1, None),
    ("buck_converter", "bootstrap_circuit", "gate_charge_nc", "bootstrap_capacitance_nf", 1, None),
    ("buck_converter", "output_filter", "switching_frequency_hz", "inductance_uh", -1, None),
    ("buck_converter", "output_filter", "ripple_budget_mv", "output_capacitance_uf", -1, None),
)


def blocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BLOCKS, "topology string, block string, label string, depends_on array<string>")


def laws(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAWS, "topology string, block string, parameter string, affects string, sign int, condition string")


def topology_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Nodes of the topologies and blocks, and PART_OF edges with the block's laws."""
    block_id, topology_id = F.concat_ws(":", F.lit("block"), "topology", "block"), F.concat(F.lit("topology:"), "topology")
    tops = spark.createDataFrame(list(TOPOLOGIES.items()), "topology string, label string").select(topology_id.alias("id"), F.lit("TOPOLOGY").alias("node_type"), "label", F.lit(1).alias("layer"))
    parts = blocks(spark)
    nodes = tops.unionByName(parts.select(block_id.alias("id"), F.lit("FUNCTIONAL_BLOCK").alias("node_type"), "label", F.lit(2).alias("layer"))).withColumn("confidence", F.lit(1.0))
    of_block = laws(spark).groupBy("topology", "block").agg(F.array_sort(F.collect_list(F.struct("parameter", "affects", "sign", "condition"))).alias("laws"))
    edges = parts.join(of_block, ["topology", "block"], "left").select(block_id.alias("source_id"), F.lit("PART_OF").alias("relation"), topology_id.alias("target_id"), F.lit(1.0).alias("confidence"), "laws")
    return nodes, edges


def influences(changes: DataFrame, laws: DataFrame) -> DataFrame:
    """``design_id, topology, quantity, direction, steps`` of all that ``changes(design_id, topology, quantity, sign, conditions)`` do through ``laws``.

    A law of the design's topology turns a change of its parameter into one of what it affects, in its sign's
    direction, if it has no condition or the design's ``conditions`` hold it. Changes go on until there are no new ones;
    ``steps`` counts the laws to the first of them. ``direction`` is ``up``, ``down``, or ``both`` if ways disagree. Rows
    with a null and signs other than 1 and -1 are left out; changes given twice count once. Each round joins only
    what the last one found, so that cycles of laws end.
    """
    law = laws.select("topology", F.col("parameter").alias("quantity"), "affects", F.col("sign").alias("law_sign"), "condition")
    conditions = changes.filter("conditions is not null").select("design_id", F.explode("conditions").alias("condition")).distinct()
    new = written(changes.filter("sign in (1, -1)").select("design_id", "topology", "quantity", F.col("sign").cast("int").alias("sign"), F.lit(0).alias("steps")).dropna().distinct())
    known, steps = new, 0
    while new.limit(1).count():
        steps += 1
        through = new.drop("steps").join(law, ["topology", "quantity"])
        free = through.filter("condition is null").drop("condition")
        bound = through.join(conditions, ["design_id", "condition"], "left_semi").drop("condition")
        found = free.unionByName(bound).select("design_id", "topology", F.col("affects").alias("quantity"), (F.col("sign") * F.col("law_sign")).alias("sign")).distinct()
        new = written(found.join(known.select("design_id", "topology", "quantity", "sign"), ["design_id", "topology", "quantity", "sign"], "left_anti").withColumn("steps", F.lit(steps)))
        known = known.unionByName(new)
    both = F.when(F.count_distinct("sign") > 1, "both").when(F.max("sign") == 1, "up").otherwise("down")
    return known.groupBy("design_id", "topology", "quantity").agg(both.alias("direction"), F.min("steps").alias("steps"))
