"""Writers: corrected items as JSON lines, netlists and reports as text, one document a design."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_corrected(items: DataFrame, path: str) -> None:
    """Corrected items as JSON lines."""
    items.filter("status = 'corrected'").write.mode("overwrite").json(path)


def netlist_text(nets: DataFrame) -> DataFrame:
    """``design_id, value``: an S-expression netlist of ``net_pins(design_id, net_name, ref, pin_number)``."""
    node = F.concat(F.lit("    (node (ref "), "ref", F.lit(") (pin "), "pin_number", F.lit("))"))
    per = nets.groupBy("design_id", "net_name").agg(F.array_join(F.array_sort(F.collect_list(node)), "\n").alias("nodes"))
    net = F.concat(F.lit('  (net (name "'), "net_name", F.lit('")\n'), "nodes", F.lit(")"))
    return per.groupBy("design_id").agg(F.concat(F.lit("(export\n"), F.array_join(F.array_sort(F.collect_list(net)), "\n"), F.lit(")")).alias("value"))


def report_text(bom: DataFrame, violations: DataFrame) -> DataFrame:
    """``design_id, value``: a markdown report, most severe findings first."""
    line = F.concat_ws(" | ", F.lit(""), "ref", "component_type", F.coalesce("part", F.lit("-")), F.format_string("%.2f", "confidence"), F.lit(""))
    parts = bom.groupBy("design_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("rows"), F.round(F.avg("confidence"), 4).alias("c"))
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    found = violations.groupBy("design_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.concat_ws(" ", F.lit("-"), "severity", "rule", "subject").alias("t")))), lambda v: v["t"]), "\n").alias("found"))
    return parts.join(found, "design_id", "left").select("design_id", F.concat(F.lit("# "), "design_id", F.format_string("\n\nConfidence %.4f\n\n", "c"), "rows", F.lit("\n\n## Findings\n\n"), F.coalesce("found", F.lit("none"))).alias("value"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``value``: one GraphML element a row for ``nodes(id, properties map)`` and ``edges(source_id, target_id, properties map)``, the properties as a JSON blob.

    Such rows are the inside of a graph element; `write_graphml` writes whole files.
    """
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    data = F.concat(F.lit('<data key="properties">'), safe(F.to_json("properties")), F.lit("</data>"))
    node = nodes.select(F.concat(F.lit('<node id="'), safe(F.col("id")), F.lit('">'), data, F.lit("</node>")).alias("value"))
    edge = edges.select(F.concat(F.lit('<edge source="'), safe(F.col("source_id")), F.lit('" target="'), safe(F.col("target_id")), F.lit('">'), data, F.lit("</edge>")).alias("value"))
    return node.unionByName(edge)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML files for the tables of `graphml_lines`, a graph element a file: those of nodes in ``path``/nodes, of edges in ``path``/edges.

    `knowledge.graphml` reads them back, and files that hold both.
    """
    data = F.struct(F.lit("properties").alias("_key"), F.to_json("properties").alias("_VALUE")).alias("data")
    kinds = (("node", nodes.select(F.col("id").alias("_id"), data)), ("edge", edges.select(F.col("source_id").alias("_source"), F.col("target_id").alias("_target"), data)))
    for kind, rows in kinds:
        rows.write.format("xml").option("rootTag", "graph").option("rowTag", kind).save(f"{path}/{kind}s")


def write_text(documents: DataFrame, path: str) -> None:
    """One folder a design, one text file in it."""
    documents.write.mode("overwrite").partitionBy("design_id").text(path)
