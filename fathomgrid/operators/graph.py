"""A property graph as two tables: nodes(id, ...) and edges(source_id, relation, target_id, confidence, ...)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.session import written

from .aggregates import filled_counts
from .relational import last_wins

#: The relations that a search follows.
FOLLOWED = ("REQUIRES", "USES", "HAS_PROPERTY", "MUST_BE_NEAR", "REQUIRES_ROUTING", "PART_OF", "GOVERNED_BY")


def upsert_nodes(nodes: DataFrame, changes: DataFrame, version: str) -> DataFrame:
    """Nodes after the changes; the last version of an id stays. Both have the same columns."""
    return last_wins(nodes.unionByName(changes), ["id"], [F.col(version)])


def upsert_edges(edges: DataFrame, changes: DataFrame, nodes: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """``(edges, refused)``: one edge an ordered pair, the last whatever its relation; changes without an end in ``nodes`` are refused."""
    ends = nodes.select(F.col("id").alias("_n")).distinct()
    ok = changes.join(ends, F.col("source_id") == F.col("_n"), "left_semi").join(ends, F.col("target_id") == F.col("_n"), "left_semi")
    refused = changes.join(ends, F.col("source_id") == F.col("_n"), "left_anti").unionByName(changes.join(ends, F.col("source_id") == F.col("_n"), "left_semi").join(ends, F.col("target_id") == F.col("_n"), "left_anti"))
    return last_wins(edges.unionByName(ok), ["source_id", "target_id"], [F.col(version)]), refused


def usable(edges: DataFrame, least: float = 0.0, relations: Sequence[str] | None = None) -> DataFrame:
    kept = edges.filter(F.col("confidence") >= least)
    return kept.filter(F.col("relation").isin(*relations)) if relations else kept


def select_nodes(nodes: DataFrame, node_type: str | None = None, layer: int | None = None, ids: Sequence[str] | None = None, having: str | None = None) -> DataFrame:
    """Nodes of a type, a layer, some ids, or with a value in a column; what isn't given doesn't filter."""
    tests = [F.col("node_type") == node_type if node_type is not None else None, F.col("layer") == layer if layer is not None else None, F.col("id").isin(*ids) if ids is not None else None, F.col(having).isNotNull() if having is not None else None]
    for test in tests:
        nodes = nodes.filter(test) if test is not None else nodes
    return nodes


def neighbours(nodes: DataFrame, edges: DataFrame, start: DataFrame, least: float = 0.0, relations: Sequence[str] | None = None) -> DataFrame:
    """Nodes at the end of an edge from ``start(id)``."""
    out = usable(edges, least, relations).join(start.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return nodes.join(out.select(F.col("target_id").alias("id")).distinct(), "id", "left_semi")


def reach(edges: DataFrame, start: DataFrame, depth: int = 4, least: float = 0.60, relations: Sequence[str] | None = FOLLOWED) -> tuple[DataFrame, DataFrame]:
    """``(visited, crossed)``: ids with depth and path confidence, and the edges that reached them first.

    The confidence of a path is the product of its edges'. A node keeps its first
    level; among that level's edges the one of highest path confidence wins, then the
    smallest source. Levels are a driver loop, each a join and an aggregation; from the
    first on they are written to the checkpoint folder, if one is set, so each runs once.
    """
    good = usable(edges, least, relations).select("source_id", "target_id", "relation", F.col("confidence").alias("edge_confidence"))
    visited = start.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"))
    frontier, crossed = visited, None
    for level in range(1, depth + 1):
        step = good.join(frontier.select(F.col("id").alias("source_id"), "confidence"), "source_id")
        step = step.join(visited.select(F.col("id").alias("target_id")), "target_id", "left_anti")
        step = step.withColumn("path", F.col("confidence") * F.col("edge_confidence"))
        # the smallest source among equal paths
        best = step.groupBy("target_id").agg(F.min(F.struct((-F.col("path")).alias("neg"), "source_id", "relation", "edge_confidence")).alias("b"))
        new = best.select(F.col("target_id").alias("id"), F.lit(level).alias("depth"), (-F.col("b.neg")).alias("confidence"), "b.source_id", "b.relation", "b.edge_confidence")
        new = written(new)
        if new.isEmpty():
            break
        part = new.select("source_id", "relation", F.col("id").alias("target_id"), F.col("edge_confidence").alias("confidence"), "depth")
        crossed = part if crossed is None else crossed.unionByName(part)
        frontier = new.select("id", "depth", "confidence")
        visited = visited.unionByName(frontier)
    if crossed is None:
        crossed = good.limit(0).select("source_id", "relation", "target_id", F.col("edge_confidence").alias("confidence"), F.lit(0).alias("depth"))
    return visited, crossed


def query_graph(nodes: DataFrame, edges: DataFrame, goals: DataFrame, active: Sequence[str] = (), suppressed: Sequence[str] = (), depth: int = 4, least: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """``(found, rules)`` for ``goals(slug)``: start nodes, what is reached from them, and the crossed edges that carry constraints.

    ``found`` has the nodes' columns with depth, path_confidence and category: a type in
    ``active`` (any, if empty) and not in ``suppressed`` is kept. ``edges`` may have a
    map column ``constraints``. No match gives no rows.
    """
    start = start_nodes(nodes, edges, goals)
    visited, crossed = reach(edges, start, depth, least)
    if "constraints" in edges.columns:
        given = edges.select("source_id", "target_id", "relation", "constraints")
        crossed = crossed.join(given, ["source_id", "target_id", "relation"])
    found, rules = subgraph(nodes, visited, crossed)
    kind = F.col("node_type")
    keep = kind.isin(*active) if active else F.lit(True)
    kept = found.filter(keep & ~kind.isin(*suppressed)) if suppressed else found.filter(keep)
    category = F.when(kind.isin("COMPONENT_TYPE", "COMPONENT_INSTANCE"), "components").when(kind == "TOPOLOGY", "topologies").when(kind == "FUNCTIONAL_BLOCK", "blocks").when(kind == "PROPERTY", "properties").otherwise("other")
    return kept.withColumn("category", category), rules


def start_nodes(nodes: DataFrame, edges: DataFrame, goals: DataFrame) -> DataFrame:
    """Ids for ``goals(slug)``: nodes whose last id part is the slug, and all that are part of such a topology."""
    hit = nodes.join(goals.select(F.col("slug").alias("_s")).distinct(), F.element_at(F.split("id", ":"), -1) == F.col("_s"), "left_semi")
    parts = edges.filter(F.col("relation") == "PART_OF").join(hit.filter(F.col("node_type") == "TOPOLOGY").select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return hit.select("id").union(parts.select(F.col("source_id").alias("id"))).distinct()


def match_goal(nodes: DataFrame, goal: str, limit: int = 5) -> DataFrame:
    """Ids for a goal text: exact label, else all its words, else most of its words over three letters; ties by id."""
    words = [w for w in dict.fromkeys(goal.lower().replace("_", " ").split()) if w]
    label = F.lower(F.replace("label", F.lit("_"), F.lit(" ")))
    count = lambda some: sum((F.when(F.contains(label, F.lit(w)), 1).otherwise(0) for w in some), F.lit(0))
    long = [w for w in words if len(w) > 3]
    tier = F.when(label == " ".join(words), 1).when((count(words) == len(words)) & F.lit(bool(words)), 2).when(count(long) > 0, 3)
    scored = nodes.select("id", tier.alias("tier"), count(long).alias("hits")).filter("tier IS NOT NULL")
    best = scored.agg(F.min("tier").alias("best"))
    return scored.join(F.broadcast(best), F.col("tier") == F.col("best"), "left_semi").orderBy(F.col("hits").desc(), "id").limit(limit).select("id", "tier", "hits")


def subgraph(nodes: DataFrame, visited: DataFrame, crossed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visited nodes with their confidence, and the crossed edges that carry constraints (a non-empty map)."""
    found = nodes.join(visited.select("id", F.col("confidence").alias("path_confidence"), "depth"), "id")
    rules = crossed.filter(F.size("constraints") > 0) if "constraints" in crossed.columns else crossed.limit(0)
    return found, rules


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``problem, key``: edges without an end, confidences out of 0..1, blank labels."""
    ids = nodes.select(F.col("id").alias("_n"))
    name = F.concat_ws("->", "source_id", "target_id").alias("key")
    parts = [
        edges.join(ids, F.col("source_id") == F.col("_n"), "left_anti").select(F.lit("orphan_source").alias("problem"), name),
        edges.join(ids, F.col("target_id") == F.col("_n"), "left_anti").select(F.lit("orphan_target").alias("problem"), name),
        edges.filter(~F.col("confidence").between(0, 1)).select(F.lit("edge_confidence").alias("problem"), name),
        nodes.filter(~F.col("confidence").between(0, 1)).select(F.lit("node_confidence").alias("problem"), F.col("id").alias("key")),
        nodes.filter(F.coalesce(F.trim("label"), F.lit("")) == "").select(F.lit("blank_label").alias("problem"), F.col("id").alias("key")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def layer_stats(nodes: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    return filled_counts(nodes, "layer", low, high)


PART_ROWS = 250_000  # parts of data sheets in a task


def datasheet_graph(sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``sheets(component_id, part, confidence, pins array<struct<number,function>>, parameters array<struct<symbol,value,section>>)``.

    A component, its pins and its properties on layer 3 and, from ``rules
    array<struct<kind,subject,relative_to,hard,distance_mm,confidence>>`` where the
    column is given, its placement rules on layer 4, numbered by their position. Nodes
    have their fields that aren't null as ``properties``. Property ids don't tell
    repeated symbols apart: of nodes of one id the last of the sheet stays. A null symbol
    or section is ``unknown``; null arrays count as empty. Sheets are written once, as each kind of
    part reads them, and parts are dealt to tasks of about ``PART_ROWS``.
    """
    sheets = written(sheets)
    held_parts = sum((F.greatest(F.size(c), F.lit(0)) for c in ("pins", "parameters", "rules") if c in sheets.columns), F.lit(1))
    tasks = max(int(sheets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sheets.agg(F.sum(held_parts)).first()[0] or 0) // PART_ROWS))
    own = F.concat(F.lit("component:"), "component_id")
    at = lambda kind, *parts: F.concat_ws(":", F.lit(kind), "component_id", *parts)
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))

    def held(column: str) -> Column:
        """The fields of a struct column that aren't null, as a map of strings."""
        fields = sheets.schema[column].dataType.elementType.names
        return F.map_from_entries(F.array_compact(F.array(*(F.when(F.col(f"_x.{f}").isNotNull(), F.struct(F.lit(f).alias("key"), F.col(f"_x.{f}").cast("string").alias("value"))) for f in fields))))

    def part(column: str, node_type: str, relation: str, layer: int, id_: Column, label: Column, confidence: Column) -> DataFrame:
        rows = sheets.select("component_id", "confidence", F.posexplode(column).alias("_pos", "_x"))
        return rows.select(own.alias("source_id"), F.lit(relation).alias("relation"), id_.alias("id"), F.lit(node_type).alias("node_type"), label.alias("label"), confidence.alias("confidence"), F.lit(layer).alias("layer"), held(column).alias("properties"), "_pos")

    x, pos = (lambda f: F.col(f"_x.{f}")), F.col("_pos").cast("string")
    parts = [
        part("pins", "PIN", "HAS_PIN", 3, at("pin", x("number")), x("function"), F.col("confidence")),
        part("parameters", "PROPERTY", "HAS_PROPERTY", 3, at("property", unknown(x("symbol")), unknown(x("section"))), x("symbol"), F.col("confidence")),
    ]
    if "rules" in sheets.columns:
        label = F.concat(x("kind"), F.lit(": "), x("subject"), F.lit(" -> "), x("relative_to"))
        parts.append(part("rules", "PLACEMENT_RULE", "GOVERNED_BY", 4, at("placement_rule", pos), label, F.coalesce(x("confidence"), "confidence")))
    rows = reduce(DataFrame.unionByName, parts)
    comp = sheets.select(own.alias("id"), F.lit("COMPONENT_INSTANCE").alias("node_type"), F.col("part").alias("label"), "confidence", F.lit(3).alias("layer"), F.create_map(F.lit("pin_count"), F.greatest(F.size("pins"), F.lit(0)).cast("string")).alias("properties"), F.lit(0).alias("_pos"))
    node = F.struct("node_type", "label", "confidence", "layer", "properties")
    order = F.struct("_pos", "confidence", "label", F.to_json("properties"))
    nodes = comp.unionByName(rows.drop("source_id", "relation")).repartition(tasks, "id").groupBy("id").agg(F.max_by(node, order).alias("_n")).select("id", "_n.*")
    edges = rows.withColumnRenamed("id", "target_id").repartition(tasks, "target_id").groupBy("source_id", "relation", "target_id").agg(F.max_by("confidence", order).alias("confidence"), F.max("layer").alias("layer"))
    return nodes, edges


def import_counts(made: DataFrame, stored: DataFrame) -> DataFrame:
    """``node_type, created, updated`` of made nodes, by whether the stored graph holds their id."""
    old = stored.select("id").distinct().withColumn("_old", F.lit(True))
    return made.join(old, "id", "left").groupBy("node_type").agg(F.count_if(F.col("_old").isNull()).alias("created"), F.count("_old").alias("updated"))


def derived_edges(metrics: DataFrame) -> DataFrame:
    """Provenance of ``metrics(metric_id, inputs array<string>, confidence)``: one DERIVED_FROM edge an input."""
    return metrics.select(F.col("metric_id").alias("source_id"), F.lit("DERIVED_FROM").alias("relation"), F.explode(F.array_distinct("inputs")).alias("target_id"), "confidence")
