"""Knowledge tables: requirements, constraints, triples, topologies and the checks between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomgrid.functions.blocks import block_ratio
from fathomgrid.functions.text import contains_any, mapped, slug

from .joins import dealt_join, group_pairs, member_pairs

#: Verbs by the relation that they express.
VERBS = {
    "require": "REQUIRES", "requires": "REQUIRES", "need": "REQUIRES", "needs": "REQUIRES", "must have": "REQUIRES", "depend on": "REQUIRES", "depends on": "REQUIRES", "requirement": "REQUIRES", "needs to have": "REQUIRES", "must possess": "REQUIRES", "necessitate": "REQUIRES", "necessitates": "REQUIRES",
    "use": "USES", "uses": "USES", "utilize": "USES", "utilizes": "USES", "employ": "USES", "employs": "USES", "implement": "USES", "implements": "USES", "apply": "USES", "applies": "USES",
    "is a": "IS_A", "is an": "IS_A", "is called": "IS_A", "is known as": "IS_A", "refers to": "IS_A", "is classified as": "IS_A", "belongs to the category": "IS_A", "is considered": "IS_A", "defines": "IS_A", "defines a": "IS_A", "is defined as": "IS_A",
    "has": "HAS_PROPERTY", "have": "HAS_PROPERTY", "exhibit": "HAS_PROPERTY", "exhibits": "HAS_PROPERTY", "possess": "HAS_PROPERTY", "possesses": "HAS_PROPERTY", "provide": "HAS_PROPERTY", "provides": "HAS_PROPERTY", "offers": "HAS_PROPERTY", "features": "HAS_PROPERTY", "includes": "HAS_PROPERTY", "contains": "HAS_PROPERTY", "is characterized by": "HAS_PROPERTY", "demonstrates": "HAS_PROPERTY", "show": "HAS_PROPERTY", "shows": "HAS_PROPERTY",
    "connect": "CONNECTS_TO", "connects": "CONNECTS_TO", "connect to": "CONNECTS_TO", "connects to": "CONNECTS_TO", "wire": "CONNECTS_TO", "wires": "CONNECTS_TO", "wire to": "CONNECTS_TO", "link": "CONNECTS_TO", "links": "CONNECTS_TO", "couple": "CONNECTS_TO", "couples": "CONNECTS_TO", "attach": "CONNECTS_TO", "attaches": "CONNECTS_TO", "interface": "CONNECTS_TO", "interfaces": "CONNECTS_TO", "interface with": "CONNECTS_TO",
    "part of": "PART_OF", "component of": "PART_OF", "belong to": "PART_OF", "belongs to": "PART_OF", "constituent of": "PART_OF", "member of": "PART_OF", "element of": "PART_OF", "section of": "PART_OF", "module of": "PART_OF",
    "incompatible": "INCOMPATIBLE_WITH", "incompatible with": "INCOMPATIBLE_WITH", "cannot connect": "INCOMPATIBLE_WITH", "conflicts with": "INCOMPATIBLE_WITH", "interferes with": "INCOMPATIBLE_WITH", "cannot interface": "INCOMPATIBLE_WITH", "mutually exclusive": "INCOMPATIBLE_WITH", "opposes": "INCOMPATIBLE_WITH",
    "override": "OVERRIDES", "overrides": "OVERRIDES", "supersede": "OVERRIDES", "supersedes": "OVERRIDES",
    "governed by": "GOVERNED_BY", "controlled by": "GOVERNED_BY", "regulated by": "GOVERNED_BY", "constrained by": "GOVERNED_BY", "limited by": "GOVERNED_BY",
    "replace": "REPLACES", "replaces": "REPLACES", "substitute": "REPLACES", "substitutes": "REPLACES", "substitute for": "REPLACES", "is alternative to": "REPLACES", "is an alternative to": "REPLACES",
}

#: Design methods, their board and clearance.
METHODS = (("standard_SMD", 2, "FR4", 0.15), ("RF_highfreq", 4, "Rogers_4003C", 0.10), ("power_management", 2, "FR4", 0.30), ("mixed_signal", 4, "FR4", 0.15), ("through_hole", 2, "FR4", 0.25))


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METHODS, "methodology string, layers int, material string, clearance_mm double")


def board_of(designs: DataFrame, spark: SparkSession) -> DataFrame:
    """Designs with their method's board; an unknown method takes that of standard parts."""
    known = methods(spark)
    default = known.filter("methodology = 'standard_SMD'").drop("methodology").withColumnsRenamed({c: f"_{c}" for c in known.columns})
    joined = designs.join(F.broadcast(known), "methodology", "left").crossJoin(F.broadcast(default))
    return joined.select(*designs.columns, *(F.coalesce(c, f"_{c}").alias(c) for c in ("layers", "material", "clearance_mm")))


def triples(found: DataFrame, least: float = 0.65) -> DataFrame:
    """Edges of ``found(subject, verb, object, confidence)`` whose verb is known and whose confidence is enough."""
    edges = found.filter(F.col("confidence") >= least).withColumn("relation", mapped(F.col("verb"), VERBS)).filter("relation IS NOT NULL")
    return edges.select(slug(F.col("subject")).alias("source_id"), "relation", slug(F.col("object")).alias("target_id"), "confidence")


def node_kind(label: Column) -> Column:
    """Kind of a node from its label: a measurement, a design pattern, else a component type."""
    measure = F.rlike(label, F.lit(r"(?i)\d+(\.\d+)?\s*(m|k|µ|u|n|p)?(v|a|hz|ohm|f|s|w|db)\b"))
    return F.when(measure, "PROPERTY").when(contains_any(label, ("converter", "amplifier", "filter", "oscillator", "regulator circuit")), "DESIGN_PATTERN").otherwise("COMPONENT_TYPE")


#: Words that make a subject a design recipe, and the units of measurements.
RECIPE_WORDS = ("design", "circuit", "topology", "converter", "amplifier", "filter", "oscillator", "regulator", "driver", "rectifier", "inverter", "charge pump", "reference", "bias")
UNITS = ("mV", "V", "mA", "A", "µA", "uA", "kΩ", "Ω", "ohm", "Hz", "kHz", "MHz", "GHz", "pF", "nF", "µF", "uF", "mF", "F", "dB", "ppm", "ppb")
#: Prefixes of node ids.
PREFIXES = {"DESIGN_RECIPE": "design_recipe", "COMPONENT_TYPE": "component_type", "ELECTRICAL_PROPERTY": "electrical_property"}


def measured(text: Column) -> Column:
    """Whether a text holds a number by itself or with a unit; letters and digits of any script bound a word."""
    edge = r"[\p{L}\p{N}_]"
    return F.rlike(text, F.lit(rf"(?iu)(?<!{edge})\d+\.?\d*(?:\s*(?:{'|'.join(UNITS)}))?(?!{edge})"))


def typed_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` on layer 2 of design triples ``found(subject, relation, object, confidence)``.

    A subject with a recipe's word is a DESIGN_RECIPE, an object with a measurement an
    ELECTRICAL_PROPERTY, either a COMPONENT_TYPE otherwise; ids are the kind and the
    name's words. Of nodes and edges of one id the most confident stays (of equals the
    smallest label). Triples without a subject, a relation or an object, or whose names
    hold no letter or digit, are left out.
    """
    name = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", "_"), r"[^\p{L}\p{N}_]", ""), r"^_+|_+$", "")
    kinds = {"subject": F.when(contains_any(F.col("subject"), RECIPE_WORDS), "DESIGN_RECIPE").otherwise("COMPONENT_TYPE"), "object": F.when(measured(F.col("object")), "ELECTRICAL_PROPERTY").otherwise("COMPONENT_TYPE")}
    mapped_kind = lambda kind: F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in PREFIXES.items()))
    node = lambda c: F.struct(F.concat_ws(":", mapped_kind(kinds[c]), name(F.col(c))).alias("id"), kinds[c].alias("node_type"), F.col(c).alias("label"))
    named = found.filter((name(F.col("subject")) != "") & (name(F.col("object")) != "") & F.col("relation").isNotNull())
    rows = named.select(node("subject").alias("s"), "relation", node("object").alias("o"), "confidence")
    ends = rows.select("confidence", F.explode(F.array("s", "o")).alias("n")).select("n.*", "confidence")
    nodes = ends.groupBy("id").agg(F.min("node_type").alias("node_type"), F.min_by("label", F.struct(-F.col("confidence"), "label")).alias("label"), F.max("confidence").alias("confidence")).withColumn("layer", F.lit(2))
    edges = rows.groupBy(F.col("s.id").alias("source_id"), "relation", F.col("o.id").alias("target_id")).agg(F.max("confidence").alias("confidence")).withColumn("layer", F.lit(2))
    return nodes, edges


def placement_graph(rules: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New nodes and edges of ``rules(subject, target, kind, confidence)``; empty subjects and low confidence are left out."""
    good = rules.filter((F.coalesce(F.trim("subject"), F.lit("")) != "") & (F.col("confidence") >= 0.65))
    rule = F.concat(F.lit("placement:"), F.sha2(F.concat_ws("|", "subject", "target", "kind"), 256))
    edges = good.select(slug(F.col("subject")).alias("source_id"), F.lit("GOVERNED_BY").alias("relation"), rule.alias("target_id"), "confidence")
    made = good.select(rule.alias("id"), F.lit("PLACEMENT_RULE").alias("node_type"), F.concat_ws(" ", "subject", "kind", "target").alias("label"), "confidence")
    subjects = good.select(slug(F.col("subject")).alias("id"), F.lit("COMPONENT_TYPE").alias("node_type"), F.col("subject").alias("label"), F.col("confidence"))
    missing = subjects.join(nodes.select("id"), "id", "left_anti").groupBy("id").agg(F.first("node_type").alias("node_type"), F.min("label").alias("label"), F.max("confidence").alias("confidence"))
    return made.dropDuplicates(["id"]).unionByName(missing), edges


def constraint_nodes(intents: DataFrame, groups: dict[str, str]) -> DataFrame:
    """One node for each design, kind and scope of ``intents``; ``groups`` maps a kind to its struct column.

    Every field of the struct that isn't null is an entry of the node's properties.
    """
    parts = []
    for kind, column in groups.items():
        fields = intents.schema[column].dataType.names
        entries = F.array_compact(F.array(*(F.when(F.col(f"{column}.{f}").isNotNull(), F.struct(F.lit(f).alias("key"), F.col(f"{column}.{f}").cast("string").alias("value"))) for f in fields)))
        parts.append(intents.filter(F.col(column).isNotNull()).select(F.concat_ws(":", F.lit("constraint"), "design_id", F.lit(kind), F.coalesce("scope", F.lit("global"))).alias("id"), "design_id", F.lit(kind).alias("kind"), F.map_from_entries(entries).alias("properties")))
    return reduce(DataFrame.unionByName, parts).filter(F.size("properties") > 0).dropDuplicates(["id"])


def contradictions(designs: DataFrame) -> DataFrame:
    """``design_id, rule, severity`` for ``designs(design_id, temp_min_c, supply_topology, implications array<string>, requirements array<string>, protections array<string>)``.

    Each unmet protection is a finding of its own.
    """
    has = lambda name: F.coalesce(F.array_contains("implications", name), F.lit(False))
    bypass = F.coalesce(F.exists("requirements", lambda r: F.rlike(r, F.lit("(?i)bypass|decoupling"))), F.lit(False))
    found = [
        F.when((F.col("temp_min_c") < -40) & (F.size("implications") > 0), F.struct(F.lit("temperature_grade").alias("rule"), F.lit("WARNING").alias("severity"))),
        F.when((F.col("supply_topology") == "single_dc") & has("zero_drift_op_amp") & ~has("negative_rail_converter"), F.struct(F.lit("no_negative_rail").alias("rule"), F.lit("CRITICAL").alias("severity"))),
        F.when(has("low_noise_ldo") & ~bypass, F.struct(F.lit("no_bypass").alias("rule"), F.lit("WARNING").alias("severity"))),
    ]
    unmet = F.transform(F.coalesce("protections", F.array().cast("array<string>")), lambda p: F.struct(F.concat(F.lit("protection:"), p).alias("rule"), F.lit("WARNING").alias("severity")))
    return designs.select("design_id", F.explode(F.concat(F.array_compact(F.array(*found)), unmet)).alias("f")).select("design_id", "f.*")


def axiom_conflicts(axioms: DataFrame, alike: float = 0.6, block: int = 10_000, digits: int | None = None) -> DataFrame:
    """Pairs of axioms ``axiom_id, implication, requirement`` with the same implication and unlike requirements, by their matching blocks.

    Distinct texts are compared, once a pair, and their axioms are paired afterwards; the ratio is rounded to ``digits``, if given, once a pair of texts.
    """
    held = axioms.filter("implication IS NOT NULL AND requirement IS NOT NULL AND axiom_id IS NOT NULL").select("implication", "axiom_id", F.lower("requirement").alias("text"))
    texts = held.select("implication", "text").distinct()
    ordered = group_pairs(texts, ["implication"], "text", block)
    pairs = ordered.unionByName(texts.select("implication", F.col("text").alias("text_a"), F.col("text").alias("text_b")))
    # the blocks depend on which text comes first, so both orders are compared; axioms of one text pair one way
    there, back = block_ratio("text_a", "text_b"), block_ratio("text_b", "text_a")
    apart = pairs.select("text_a", "text_b").distinct().withColumns({"there": there, "back": back})
    near = lambda c: F.when(F.col(c) < alike, F.col(c) if digits is None else F.round(c, digits))
    apart = apart.select("text_a", "text_b", near("there").alias("there"), F.when(F.col("text_a") != F.col("text_b"), near("back")).alias("back")).filter("there IS NOT NULL OR back IS NOT NULL")
    found = member_pairs(pairs.join(apart, ["text_a", "text_b"]), held, ["implication"], "text", "axiom_id", min(block, 1_000))
    one, other = F.col("axiom_id_a"), F.col("axiom_id_b")
    rows = found.withColumn("ratio", F.when(one < other, F.col("there")).when(one > other, F.col("back"))).filter("ratio IS NOT NULL")
    return rows.select("implication", F.least(one, other).alias("a"), F.greatest(one, other).alias("b"), "ratio")


def role_candidates(roles: DataFrame, components: DataFrame, block: int = 1_000) -> DataFrame:
    """Components for ``roles(pattern_id, role, part, category)``: the named part, else those of the category at 0.8.

    The roles of a part or category are dealt to parts of about ``block``, so that a large category isn't one task.
    """
    named = dealt_join(components.select("component_id", "part"), roles.filter("part IS NOT NULL").drop("category"), ["part"], block)
    open_ = dealt_join(components.select("component_id", "category"), roles.filter("part IS NULL").drop("part"), ["category"], block)
    return named.select("pattern_id", "role", "component_id", F.lit(1.0).alias("score")).unionByName(open_.select("pattern_id", "role", "component_id", F.lit(0.8).alias("score")))


def scoped_records(nodes: DataFrame, design: str, kind: str) -> DataFrame:
    """The records of one design and kind."""
    return nodes.filter((F.col("design_id") == design) & (F.col("kind") == kind))


def resolve_symbols(bom: DataFrame, generated: DataFrame, fixed: DataFrame, by_type: DataFrame, default: str = "Device:IC") -> DataFrame:
    """``symbol, symbol_source, needs_review`` for ``bom(part, component_type)``: a generated map by part, a fixed map by part, a map by type, else the default, to be reviewed.

    The maps are ``(part, symbol)``, ``(part, symbol)`` and ``(component_type, symbol)``;
    a key that is repeated takes its smallest symbol.
    """
    one = lambda rows, key, name: rows.groupBy(F.col(key).alias(f"_{name}")).agg(F.min("symbol").alias(name))
    out = bom.join(one(generated, "part", "g"), F.col("part") == F.col("_g"), "left").join(one(fixed, "part", "f"), F.col("part") == F.col("_f"), "left").join(one(by_type, "component_type", "t"), F.col("component_type") == F.col("_t"), "left")
    source = F.when(F.col("g").isNotNull(), "generated").when(F.col("f").isNotNull(), "fixed").when(F.col("t").isNotNull(), "type").otherwise("default")
    return out.select(*bom.columns, F.coalesce("g", "f", "t", F.lit(default)).alias("symbol"), source.alias("symbol_source"), (source == "default").alias("needs_review"))


def layout_gate(constraints: DataFrame, least: float = 0.85) -> DataFrame:
    """Designs with a hard constraint of too little confidence."""
    return constraints.filter(F.col("hard") & (F.col("confidence") < least)).groupBy("design_id").agg(F.count("*").alias("n"), F.min("confidence").alias("lowest"))


def phases_to_run(phases: DataFrame, done: DataFrame) -> DataFrame:
    """The phases of a run that aren't in the checkpoint table, up to the first gap in order: all that follow it run again."""
    state = phases.join(done.select("run_id", "phase").distinct().withColumn("_d", F.lit(True)), ["run_id", "phase"], "left")
    gap = F.max(F.when(F.col("_d").isNull(), 1).otherwise(0)).over(Window.partitionBy("run_id").orderBy("pos"))
    return state.withColumn("_gap", gap).filter("_gap = 1").drop("_gap", "_d")


def capped_history(history: DataFrame, n: int, time: str, tie: str) -> DataFrame:
    """The newest ``n`` rows."""
    return history.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(n)


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Runs by outcome with their share."""
    total = F.sum("n").over(Window.partitionBy())
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n")).select("outcome", "n", F.round(F.col("n") / total, 4).alias("share"))


def header_fields(text: Column) -> Column:
    """``struct(part, package, supply)`` from the first lines of a data sheet."""
    of = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.struct(of(r"\b([A-Z]{2,5}\d{2,6}[A-Z0-9-]*)\b").alias("part"), of(r"(?i)\b((?:SOT|SOIC|TSSOP|QFN|LQFP|DIP|TO)-?\d+(?:-\d+)?)\b").alias("package"), of(r"(?i)(\d+(?:\.\d+)?\s*V\s*(?:to|-)\s*\d+(?:\.\d+)?\s*V)").alias("supply"))


def graphml(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Nodes or edges of GraphML files, with the JSON blob of their data element as ``properties`` (a map); null if it doesn't parse."""
    raw = spark.read.format("xml").option("rowTag", kind).load(path)
    at = [c for c in raw.columns if c.startswith("_")]
    data = F.coalesce(*(F.col(f"data.{f}").cast("string") for f in ("_VALUE",) if "data" in raw.columns)) if "data" in raw.columns else F.lit(None).cast("string")
    return raw.select(*(F.col(c).cast("string").alias(c[1:]) for c in at), F.from_json(data, "map<string,string>").alias("properties"))
