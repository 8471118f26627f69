"""Full-text and vector search of one query, rank fusion, query planning; `postings` and `ivf` search for many queries at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def text_search(docs: DataFrame, terms: Sequence[str], id_col: str, text_col: str, limit: int = 20) -> DataFrame:
    """Documents that hold every term, by how often they hold the terms per word; ties by id."""
    found = F.array_compact(F.array(*(F.when(F.contains(F.lower(F.col(text_col)), F.lit(t)), F.lit(t)) for t in terms)))
    maybe = docs.filter(F.size(found) == len(terms)).select(F.col(id_col), tokens(F.col(text_col)).alias("w"))
    hits = F.size(F.filter("w", lambda t: t.isin(*terms)))
    all_there = F.size(F.array_intersect(F.array(*map(F.lit, terms)), F.col("w"))) == len(terms)
    return maybe.filter(all_there).select(id_col, (hits / F.size("w")).alias("rank_score")).orderBy(F.col("rank_score").desc(), id_col).limit(limit)


#: Kinds of node that a search index holds, and English words that no search asks for.
SEARCHABLE = ("COMPONENT_TYPE", "COMPONENT_INSTANCE", "DESIGN_RECIPE")
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def searchable(nodes: DataFrame, kinds: Sequence[str] = SEARCHABLE) -> DataFrame:
    return nodes.filter(F.col("node_type").isin(*kinds))


def rank_documents(found: DataFrame, id_col: str, limit: int = 10) -> DataFrame:
    """``found(id, relevance, query_pos)`` once for each id, of the first query that found it, the most relevant first."""
    once = found.groupBy(id_col).agg(F.min_by("relevance", "query_pos").alias("relevance"))
    return once.orderBy(F.col("relevance").desc(), id_col).limit(limit)


def top_by_kind(results: DataFrame, kind: str, id_col: str, n: int = 5) -> DataFrame:
    """The ``n`` best fused results of each component type."""
    over = Window.partitionBy(kind).orderBy(F.round("final_score", 12).desc(), id_col)
    return results.withColumn("kind_rank", F.row_number().over(over)).filter(F.col("kind_rank") <= n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null if a side is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector_search(items: DataFrame, query: Sequence[float], id_col: str, vector_col: str, threshold: float = 0.70, limit: int = 20, keep: Column | None = None) -> DataFrame:
    """The most similar items above ``threshold``; ``keep`` filters before the top is taken."""
    rows = items.filter(keep) if keep is not None else items
    wanted = F.array(*(F.lit(float(x)) for x in query))
    rows = rows.filter(F.size(vector_col) == len(query)).select(id_col, cosine(F.col(vector_col), wanted).alias("similarity"))
    return rows.filter(F.col("similarity") > threshold).orderBy(F.col("similarity").desc(), id_col).limit(limit)


def ranked(rows: DataFrame, layer: str, score: Column, id_col: str, query: str | None = None, depth: int | None = None) -> DataFrame:
    """One layer's candidates with their rank, best score first, ties by id; the first ``depth`` only, if given.

    Without a query column the whole layer is one ranking and needs a depth: the top is
    taken in parallel and only that many rows are numbered in one task.
    """
    if query is None and depth is None:
        raise ValueError("a ranking without a query column needs a depth, or it would be numbered in one task")
    if query is None:
        rows = rows.orderBy(score.desc(), id_col).limit(depth)
    over = Window.partitionBy(*([query] if query else [F.lit(0)])).orderBy(score.desc(), id_col)
    out = rows.select(*([query] if query else []), id_col, F.lit(layer).alias("layer"), score.cast("double").alias("layer_score"), F.row_number().over(over).alias("rank"))
    return out if depth is None else out.filter(F.col("rank") <= depth)


def fuse(layers: DataFrame, id_col: str, query: str | None = None, limit: int = 10, once: bool = False) -> DataFrame:
    """Reciprocal rank fusion of ``layer, layer_score, rank`` rows.

    A candidate that a layer repeats adds every rank; with ``once`` its best rank only.
    """
    keys = [query] if query else []
    if once:
        layers = layers.groupBy(*keys, id_col, "layer").agg(F.max("layer_score").alias("layer_score"), F.min("rank").alias("rank"))
    scores = layers.groupBy(*keys, id_col).agg(
        F.sum(1.0 / (F.col("rank") + RRF_K)).alias("final_score"),
        F.array_sort(F.collect_set("layer")).alias("source_layers"),
    )
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.round("final_score", 12).desc(), id_col)
    return scores.withColumn("position", F.row_number().over(over)).filter(F.col("position") <= limit)


def layer_hits(results: DataFrame, layers: Sequence[str], column: str = "source_layers") -> DataFrame:
    """How many results each layer took part in; layers without any are there with 0."""
    counts = results.agg(*(F.count_if(F.array_contains(column, name)).alias(name) for name in layers))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("layer"), F.col(n).alias("hits")) for n in layers))).alias("x")).select("x.*")


def expand_query(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """The text and, for each synonym group with a term in it, the group's terms that are absent."""
    low = F.lower(text)
    extra = [F.when(F.coalesce(*(F.when(F.contains(low, F.lit(t.lower())), F.lit(True)) for t in group), F.lit(False)) & ~F.contains(low, F.lit(term.lower())), F.lit(term)) for group in groups for term in group]
    return F.concat_ws(" ", text, F.array_join(F.array_distinct(F.array_compact(F.array(*extra))), " ")) if extra else text


#: What an implied requirement asks of a component.
IMPLICATIONS = {
    "precision_voltage_reference": ("precision_voltage_reference", {"tempco_ppm_C": "<10", "noise_uVpp": "<10"}),
    "low_noise_ldo": ("low_noise_ldo", {"noise_uVrms": "<10", "psrr_dB": ">60"}),
    "zero_drift_op_amp": ("zero_drift_op_amp", {"vos_drift_uV_C": "<0.1", "noise_nV_rtHz": "<10"}),
    "negative_rail_converter": ("negative_rail_converter", {"type": "inverting"}),
    "passive_compensation_network": ("passive_component", {}),
    "precision_resistor_pair": ("precision_resistor", {"tempco_ppm_C": "<5", "tolerance_pct": "<0.01"}),
}
PRIORITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def priority_rank(priority: Column) -> Column:
    return F.coalesce(*(F.when(priority == p, F.lit(i)) for i, p in enumerate(PRIORITIES)), F.lit(99))


def plan_components(requirements: DataFrame) -> DataFrame:
    """Component queries from ``design_id, pos, implication, priority, requirement``, most urgent first."""
    wanted = requirements.filter(F.col("implication").isNotNull() & (F.col("implication") != "pcb_layout_constraint"))
    kind = F.coalesce(*(F.when(F.col("implication") == k, F.lit(t)) for k, (t, _) in IMPLICATIONS.items()), F.col("implication"))
    needs = F.coalesce(*(F.when(F.col("implication") == k, F.create_map(*(F.lit(x) for pair in a.items() for x in pair)) if a else F.create_map().cast("map<string,string>")) for k, (_, a) in IMPLICATIONS.items()), F.create_map().cast("map<string,string>"))
    order = Window.partitionBy("design_id").orderBy(priority_rank(F.col("priority")), "pos")
    return wanted.select("design_id", kind.alias("component_type"), needs.alias("required"), F.substring("requirement", 1, 100).alias("source"), "priority", F.row_number().over(order).alias("position"))


def plan_documents(topologies: DataFrame, least: float = 0.6) -> DataFrame:
    """Document queries for topologies ``design_id, name, confidence`` of enough confidence."""
    label = F.replace("name", F.lit("_"), F.lit(" "))
    both = F.array(F.struct(F.lit("paper").alias("query_type"), F.concat(label, F.lit(" circuit design")).alias("search_term")), F.struct(F.lit("app_note").alias("query_type"), F.concat(label, F.lit(" application note")).alias("search_term")))
    return topologies.filter(F.col("confidence") >= least).select("design_id", F.explode(both).alias("q"), F.concat(F.lit("topology:"), "name").alias("source")).select("design_id", "q.*", "source")
