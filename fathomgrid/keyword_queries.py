"""Registered queries over every word of the classifiers' vocabularies, in contexts made from the tables.

Each part's text holds one word of the vocabulary, in turn, and most hold a second one,
so that pairs of words meet; the SQL looks the words up in a table of values.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import functions as F

from fathomgrid.domain_queries import duck, made
from fathomgrid.functions import text as T
from fathomgrid.operators import graph as G
from fathomgrid.operators import knowledge as N
from fathomgrid.registry import query
from fathomgrid.session import load, scratch
from fathomgrid.sources.sinks import export_corrected


def _values(rows: Iterable[Sequence[str]]) -> str:
    """Rows of strings after their position, as VALUES of SQL."""
    return "VALUES " + ", ".join(f"({i}, {', '.join(repr(v) for v in row)})" for i, row in enumerate(rows))


def _turn(words: Sequence[str], alias: str, step: int = 1, none: int = 0) -> str:
    """A join that gives each part a word in turn, after every ``step`` parts; ``none`` turns of each round give null."""
    return f"LEFT JOIN ({_values((w,) for w in words)}) {alias}(pos, word) ON {alias}.pos = CAST(floor(p_partkey / {step}) AS BIGINT) % {len(words) + none}"


# Topologies, methods and roles

_TOPOLOGY = [(name, w, "0.9" if set(w) & set(" -_") else "0.75") for name, words in T.TOPOLOGIES.items() for w in words]
_WORDS = [w for _, w, _ in _TOPOLOGY]
_TOPOLOGY_TEXTS = f"SELECT p_partkey, 'The ' || p_name || ' with a ' || upper(a.word) || ' part' || coalesce(' and one more ' || b.word, '') AS text FROM {{part}} {_turn(_WORDS, 'a')} {_turn(_WORDS, 'b', len(_WORDS), 3)}"


@query(
    duck(
        f""", v AS (SELECT * FROM ({_values(_TOPOLOGY)}) t(pos, name, word, confidence)), m AS (SELECT p_partkey, lower(text) AS low, replace(replace(replace(lower(text), 'buck-boost', ' '), 'buck boost', ' '), 'buck_boost', ' ') AS hidden FROM texts),
h AS (SELECT p_partkey, name, arg_min(word, pos) AS word, arg_min(CAST(confidence AS DOUBLE), pos) AS c FROM m JOIN v ON contains(CASE name WHEN 'buck_boost' THEN low ELSE hidden END, word) GROUP BY ALL),
k AS (SELECT *, round(c - CASE WHEN count(*) OVER (PARTITION BY p_partkey) > 1 THEN 0.15 ELSE 0 END, 4) AS confidence FROM h)
SELECT p_partkey, name, confidence, word AS evidence, row_number() OVER (PARTITION BY p_partkey ORDER BY confidence DESC, name) - 1 AS place FROM k WHERE confidence >= 0.6""",
        texts=_TOPOLOGY_TEXTS,
    )
)
def h13_topologies_of_all_words(spark, sf):
    rows = made(spark, sf, _TOPOLOGY_TEXTS).select("p_partkey", F.posexplode(T.topologies(F.col("text"))).alias("place", "t"))
    return rows.select("p_partkey", "t.name", "t.confidence", "t.evidence", F.col("place").cast("long").alias("place"))


_METHOD = [(name, w) for name, words in T.METHODS.items() for w in words]
_METHOD_WORDS = [w for _, w in _METHOD]
_PROPOSED = [*T.METHODS, "standard_SMD"]
_METHOD_TEXTS = f"SELECT p_partkey, p.word AS proposed, p_name || ': ' || coalesce(upper(a.word), 'plain') || coalesce(', ' || b.word, '') AS text FROM {{part}} {_turn(_METHOD_WORDS, 'a', 1, 1)} {_turn(_METHOD_WORDS, 'b', 7, 9)} {_turn(_PROPOSED, 'p', 3)}"


@query(
    duck(
        f""", v AS (SELECT * FROM ({_values(_METHOD)}) t(pos, name, word)), h AS (SELECT p_partkey, arg_min(name, pos) AS named, bool_or(name = proposed) AS agreed FROM texts JOIN v ON contains(lower(text), word) GROUP BY ALL)
SELECT p_partkey, CASE WHEN named IS NOT NULL AND NOT agreed THEN named ELSE proposed END AS method, named IS NOT NULL AND NOT agreed AS overridden FROM texts LEFT JOIN h USING (p_partkey)""",
        texts=_METHOD_TEXTS,
    )
)
def h14_methods_of_all_words(spark, sf):
    rows = made(spark, sf, _METHOD_TEXTS).select("p_partkey", T.methodology(F.col("text"), F.col("proposed")).alias("x"))
    return rows.select("p_partkey", "x.method", "x.overridden")


_FUNCTIONS = f"SELECT p_partkey, coalesce(a.word, p_name) AS function FROM {{part}} {_turn(list(T.ROLES), 'a', 1, 1)}"


@query(duck(f" SELECT p_partkey, role FROM functions LEFT JOIN ({_values(T.ROLES.items())}) v(pos, name, role) ON function = name", functions=_FUNCTIONS))
def h10_roles_of_all_functions(spark, sf):
    return made(spark, sf, _FUNCTIONS).select("p_partkey", T.role(F.col("function")).alias("role"))


# Goals and prompts

_FILLERS = "|".join(T.GOAL_FILLERS)
_GOALS = f"""SELECT p_partkey, coalesce(f.word || '_', '') || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(p_size AS STRING) || 'v-' WHEN 2 THEN CAST(p_size AS STRING) || '_' ELSE replace(p_name, ' ', '_') || '_' END || coalesce(upper(n.word), '') || coalesce('_' || e.word, '') AS goal
FROM {{part}} {_turn(list(T.GOAL_NAMES), 'n', 1, 2)} {_turn(T.GOAL_FILLERS, 'f', 3, 9)} {_turn(T.GOAL_FILLERS, 'e', 11, 30)}"""


@query(
    duck(
        f""", w AS (SELECT p_partkey, list_filter(string_split(regexp_replace(regexp_replace(replace(lower(goal), '-', '_'), '^((?:{_FILLERS})(_|$))+', ''), '((^|_)(?:{_FILLERS}))+$', ''), '_'), lambda x: regexp_matches(x, '[a-z]')) AS words FROM goals)
SELECT p_partkey, CASE WHEN len(words) = 0 THEN 'unknown' WHEN full_name IS NOT NULL AND (len(words) = 1 OR len(list_filter(words[1:len(words) - 1], lambda x: regexp_matches(x, '[0-9]'))) > 0) THEN full_name ELSE array_to_string(words[1:4], '_') END AS goal
FROM w LEFT JOIN ({_values(T.GOAL_NAMES.items())}) v(pos, short, full_name) ON words[-1] = short""",
        goals=_GOALS,
    )
)
def h15_goals_of_all_names(spark, sf):
    return made(spark, sf, _GOALS).select("p_partkey", T.clean_goal(F.col("goal")).alias("goal"))


_APPLICATION_WORDS = [w for w, _ in T.APPLICATIONS]
_BOARDS = (("through_hole", "through hole"), ("through_hole", "tht"), ("through_hole", "dip"), ("4_layer", "4 layer"), ("4_layer", "four layer"), ("single_sided", "single sided"), ("single_sided", "single layer"))
_PROMPTS = f"""SELECT p_partkey, 'Please ' || coalesce(upper(a.word), 'take') || ' a ' || p_name || coalesce(' for ' || u.word, '') || coalesce(', ' || c.word, '') || coalesce(', ' || m.word, '') || coalesce('; ' || b.word, '') || '.' AS text
FROM {{part}} {_turn(T.ACTIONS, 'a', 1, 1)} {_turn(_APPLICATION_WORDS, 'u', 2, 2)} {_turn(T.CONSTRAINTS, 'c', 3, 3)} {_turn(_METHOD_WORDS, 'm', 5, 5)} {_turn([w for _, w in _BOARDS], 'b', 7, 3)}"""


@query(
    duck(
        f""", low AS (SELECT p_partkey, lower(text) AS t FROM prompts), action AS (SELECT p_partkey, arg_min(word, pos) AS word FROM low JOIN ({_values((a,) for a in T.ACTIONS)}) v(pos, word) ON contains(t, word) GROUP BY 1),
goal AS (SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(substr(t, strpos(t, word) + len(word)), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')[1:4], '_') AS goal FROM low JOIN action USING (p_partkey)),
method AS (SELECT p_partkey, arg_min(name, pos) AS method FROM low JOIN ({_values(_METHOD)}) v(pos, name, word) ON contains(t, word) GROUP BY 1),
application AS (SELECT p_partkey, arg_min(name, pos) AS application FROM low JOIN ({_values(T.APPLICATIONS)}) v(pos, word, name) ON contains(t, word) GROUP BY 1),
board AS (SELECT p_partkey, arg_min(name, pos) AS board FROM low JOIN ({_values(_BOARDS)}) v(pos, name, word) ON contains(t, word) GROUP BY 1),
held AS (SELECT p_partkey, string_agg(replace(replace(word, ' ', '_'), '-', '_'), ',' ORDER BY pos) AS constraints FROM low JOIN ({_values((c,) for c in T.CONSTRAINTS)}) v(pos, word) ON contains(t, word) GROUP BY 1)
SELECT p_partkey, coalesce(nullif(goal, ''), 'circuit') AS goal, coalesce(method, 'standard_SMD') AS method, coalesce(application, 'unspecified') AS application, coalesce(board, 'double_sided_SMD') AS board, coalesce(constraints, '') AS constraints
FROM low LEFT JOIN goal USING (p_partkey) LEFT JOIN method USING (p_partkey) LEFT JOIN application USING (p_partkey) LEFT JOIN board USING (p_partkey) LEFT JOIN held USING (p_partkey)""",
        prompts=_PROMPTS,
    )
)
def h16_prompts_of_all_words(spark, sf):
    rows = made(spark, sf, _PROMPTS).select("p_partkey", T.parse_design(F.col("text")).alias("d"))
    return rows.select("p_partkey", "d.goal", "d.method", "d.application", "d.board", F.array_join("d.constraints", ",").alias("constraints"))


_OPEN = f"SELECT p_partkey, coalesce(upper(v.word) || '_', '') || CASE WHEN p_size % 4 > 0 THEN replace(p_name, ' ', '_') ELSE '' END AS goal, CASE p_size % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN p_type ELSE '' END AS application, m.word AS method, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_retailprice AS DOUBLE) END AS frequency FROM {{part}} {_turn(T.VAGUE_GOALS, 'v', 1, 4)} {_turn(_PROPOSED, 'm', 3)}"


@query(
    duck(
        f""", vague AS (SELECT DISTINCT p_partkey FROM designs, ({_values((g,) for g in T.VAGUE_GOALS)}) v(pos, word) WHERE list_contains(string_split(replace(lower(goal), '_', ' '), ' '), word) OR len(trim(replace(goal, '_', ' '))) < 3)
SELECT p_partkey, 'goal' AS field, true AS blocking FROM vague UNION ALL SELECT p_partkey, 'application', false FROM designs WHERE application IN ('Unknown', '') UNION ALL SELECT p_partkey, 'frequency', true FROM designs WHERE method = 'RF_highfreq' AND frequency IS NULL""",
        designs=_OPEN,
    )
)
def h17_ambiguities_of_all_words(spark, sf):
    rows = made(spark, sf, _OPEN).select("p_partkey", F.explode(T.ambiguities(*(F.col(c) for c in ("goal", "application", "method", "frequency")))).alias("a"))
    return rows.select("p_partkey", "a.field", "a.blocking")


# Typed graphs

_RELATIONS = sorted(set(N.VERBS.values()))
_TRIPLES = f"""SELECT CASE WHEN p_partkey % 41 = 0 THEN '--' ELSE p_name || ' ' || coalesce(upper(k.word), p_type) END AS subject, r.word AS relation,
CASE p_partkey % 4 WHEN 0 THEN p_type || ' ' || k.word WHEN 1 THEN 'part X' || CAST(p_size AS STRING) || 'Z' WHEN 2 THEN 'about ' || CAST(p_size AS STRING) || u.word || '.' ELSE CAST(p_size AS STRING) || '.5 ' || upper(u.word) END AS object, CAST(p_retailprice AS DOUBLE) / 3000 AS confidence
FROM {{part}} {_turn(N.RECIPE_WORDS, 'k', 1, 4)} {_turn(N.UNITS, 'u', 2)} {_turn(_RELATIONS, 'r', 5)}"""
_TYPED = f""", v AS (SELECT * FROM ({_values((w,) for w in N.RECIPE_WORDS)}) t(pos, word)),
kinds AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM v WHERE contains(lower(subject), word)) THEN 'DESIGN_RECIPE' ELSE 'COMPONENT_TYPE' END AS s_kind,
CASE WHEN regexp_matches(object, '(?i)(^|[^\\pL\\pN_])\\d+\\.?\\d*(\\s*({"|".join(N.UNITS)}))?($|[^\\pL\\pN_])') THEN 'ELECTRICAL_PROPERTY' ELSE 'COMPONENT_TYPE' END AS o_kind FROM triples),
slugs AS (SELECT *, trim(regexp_replace(regexp_replace(lower(subject), '\\s+', '_', 'g'), '[^\\pL\\pN_]', '', 'g'), '_') AS s, trim(regexp_replace(regexp_replace(lower(object), '\\s+', '_', 'g'), '[^\\pL\\pN_]', '', 'g'), '_') AS o FROM kinds),
named AS (SELECT *, lower(s_kind) || ':' || s AS source_id, lower(o_kind) || ':' || o AS target_id FROM slugs WHERE s <> '' AND o <> '')"""


@query(duck(_TYPED + " SELECT id, min(kind) AS node_type, arg_min(label, (-confidence, label)) AS label, max(confidence) AS confidence FROM (SELECT source_id AS id, s_kind AS kind, subject AS label, confidence FROM named UNION ALL SELECT target_id, o_kind, object, confidence FROM named) GROUP BY 1", triples=_TRIPLES))
def h24_typed_nodes(spark, sf):
    return N.typed_graph(made(spark, sf, _TRIPLES))[0].select("id", "node_type", "label", "confidence")


@query(duck(_TYPED + " SELECT source_id, relation, target_id, max(confidence) AS confidence FROM named GROUP BY ALL", triples=_TRIPLES))
def h24_typed_edges(spark, sf):
    return N.typed_graph(made(spark, sf, _TRIPLES))[1].select("source_id", "relation", "target_id", "confidence")


# Data sheets with their rules

_SHEETS = """SELECT c_custkey, CAST(c_custkey AS STRING) AS component_id, c_name AS part, CAST(0.5 AS DOUBLE) + CAST(c_nationkey AS DOUBLE) / 64 AS confidence FROM {customer}"""
_SHEET_ORDERS = """SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS price, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS symbol, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS section, o_orderkey % 3 = 0 AS rule, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DOUBLE) / 524288 END AS rule_confidence FROM {orders}"""
_SHEET_SQL = """, placed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM held WHERE rule),
nodes AS (SELECT 'component:' || component_id AS id, 'COMPONENT_INSTANCE' AS node_type, part AS label, confidence, 3 AS layer, 1 AS n_properties FROM sheets
UNION ALL SELECT 'pin:' || o_custkey || ':' || o_orderkey, 'PIN', o_orderstatus, confidence, 3, 2 FROM held JOIN sheets ON o_custkey = c_custkey
UNION ALL SELECT 'property:' || o_custkey || ':' || coalesce(symbol, 'unknown') || ':' || coalesce(section, 'unknown'), 'PROPERTY', arg_max(coalesce(symbol, ' '), o_orderkey), any_value(confidence), 3, arg_max(1 + CAST(symbol IS NOT NULL AS INTEGER) + CAST(section IS NOT NULL AS INTEGER), o_orderkey) FROM held JOIN sheets ON o_custkey = c_custkey GROUP BY ALL
UNION ALL SELECT 'placement_rule:' || o_custkey || ':' || n, 'PLACEMENT_RULE', o_orderpriority || ': ' || o_orderstatus || ' -> pin ' || o_orderkey, coalesce(rule_confidence, confidence), 4, 5 + CAST(rule_confidence IS NOT NULL AS INTEGER) FROM placed JOIN sheets ON o_custkey = c_custkey)""".replace(" GROUP BY ALL", " GROUP BY 1")


def _sheets(spark, sf):
    each = lambda *fields: F.array_sort(F.collect_list(F.struct("o_orderkey", F.struct(*fields).alias("x"))))
    col = F.col
    held = made(spark, sf, _SHEET_ORDERS).groupBy("o_custkey").agg(
        each(col("o_orderkey").cast("string").alias("number"), col("o_orderstatus").alias("function")).alias("pins"),
        each("symbol", col("price").alias("value"), "section").alias("parameters"),
        F.array_sort(F.collect_list(F.when(col("rule"), F.struct("o_orderkey", F.struct(col("o_orderpriority").alias("kind"), col("o_orderstatus").alias("subject"), F.concat(F.lit("pin "), "o_orderkey").alias("relative_to"), (col("price") > 100000).alias("hard"), col("price").alias("distance_mm"), col("rule_confidence").alias("confidence")).alias("x"))))).alias("rules"),
    )
    inner = held.select("o_custkey", *(F.transform(c, lambda e: e["x"]).alias(c) for c in ("pins", "parameters", "rules")))
    return made(spark, sf, _SHEETS).join(inner, F.col("c_custkey") == F.col("o_custkey"), "left").select("component_id", "part", "confidence", "pins", "parameters", "rules")


@query(duck(_SHEET_SQL + " SELECT id, node_type, nullif(label, ' ') AS label, confidence, layer, n_properties FROM nodes", sheets=_SHEETS, held=_SHEET_ORDERS))
def i8_sheet_nodes_with_rules(spark, sf):
    return G.datasheet_graph(_sheets(spark, sf))[0].select("id", "node_type", "label", "confidence", "layer", F.size("properties").alias("n_properties"))


@query(duck(_SHEET_SQL + " SELECT 'component:' || split_part(id, ':', 2) AS source_id, CASE node_type WHEN 'PIN' THEN 'HAS_PIN' WHEN 'PROPERTY' THEN 'HAS_PROPERTY' ELSE 'GOVERNED_BY' END AS relation, id AS target_id, confidence, layer FROM nodes WHERE node_type <> 'COMPONENT_INSTANCE'", sheets=_SHEETS, held=_SHEET_ORDERS))
def i8_sheet_edges_with_rules(spark, sf):
    return G.datasheet_graph(_sheets(spark, sf))[1]


@query(duck(_SHEET_SQL + " SELECT node_type, count(*) FILTER (CAST(split_part(id, ':', 2) AS BIGINT) % 3 <> 0) AS created, count(*) FILTER (CAST(split_part(id, ':', 2) AS BIGINT) % 3 = 0) AS updated FROM nodes GROUP BY 1", sheets=_SHEETS, held=_SHEET_ORDERS))
def i8_import_counts(spark, sf):
    """An import over a graph that holds the nodes of every third sheet already."""
    sheets = _sheets(spark, sf)
    stored = G.datasheet_graph(sheets.filter(F.col("component_id").cast("long") % 3 == 0))[0]
    return G.import_counts(G.datasheet_graph(sheets)[0], stored)


# Corrected items, written and read back


@query("SELECT event_id AS item_id, user_id AS design_id, event_type || ' \"' || event_id || '\"' AS payload FROM events WHERE event_type = 'error'")
def a27_corrected_items(spark, sf):
    """Corrected items written as JSON lines and read back."""
    path = scratch(spark)
    status = F.when(F.col("event_type") == "error", "corrected").when(F.col("event_type") == "click", "approved").otherwise("pending")
    items = load(spark, sf, "events").select(F.col("event_id").alias("item_id"), F.col("user_id").alias("design_id"), status.alias("status"), F.concat("event_type", F.lit(' "'), "event_id", F.lit('"')).alias("payload"))
    export_corrected(items, path)
    return spark.read.schema(items.schema).json(path).drop("status")
