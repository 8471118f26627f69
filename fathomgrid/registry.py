"""The registered queries: each operator over the fixture tables, with its SQL counterpart.

The fixture tables are orders, events and documents, so an operator meets an analogue
of its own tables: line items are facts of parts, orders nets, events reviews.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomgrid.functions import text as T
from fathomgrid.functions import units as U
from fathomgrid.operators import aggregates as A
from fathomgrid.operators import graph as G
from fathomgrid.operators import joins as J
from fathomgrid.operators import knowledge as N
from fathomgrid.operators import parametric as P
from fathomgrid.operators import ranking as R
from fathomgrid.operators import relational as L
from fathomgrid.operators import retrieval as V
from fathomgrid.operators import rules as K
from fathomgrid.operators.postings import build_postings, search_postings
from fathomgrid.plans.hybrid import hybrid
from fathomgrid.session import load, load_in_order
from fathomgrid.stem_sql import ONE_SEARCH

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _facts(spark: SparkSession, sf: str, place: bool = False) -> DataFrame:
    """Facts of parts: one row a line item and symbol; with the line item's ``_file, _row`` if ``place`` is asked for."""
    li = (load_in_order if place else load)(spark, sf, "lineitem")
    at = ["_file", "_row"] if place else []
    row = lambda s, lo, typ, hi: F.struct(F.lit(s).alias("symbol"), F.col(lo).cast("double").alias("value_min"), F.col(typ).cast("double").alias("value_typ"), F.col(hi).cast("double").alias("value_max"))
    rows = F.explode(F.array(row("en", "l_discount", "l_quantity", "l_quantity"), row("tol", "l_tax", "l_discount", "l_tax"), row("PSRR", "l_quantity", "l_tax", "l_discount"))).alias("f")
    return li.select(F.col("l_partkey").alias("component_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("parameter_id"), *at, rows).select("component_id", "parameter_id", *at, "f.*")


# Scans, look-ups and upserts


@query("SELECT c_custkey, c_name, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_name = 'Customer#000000042' ORDER BY c_custkey LIMIT 1")
def a2_point_lookup(spark, sf):
    found = L.lookup(load(spark, sf, "customer"), "c_name", "Customer#000000042", owner=load(spark, sf, "nation"), on=("c_nationkey", "n_nationkey"), order="c_custkey")
    return found.select("c_custkey", "c_name", "c_acctbal", "n_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def a3_current_approved(spark, sf):
    rows = load(spark, sf, "orders").withColumn("until", F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate")))
    return L.current(rows, "o_orderstatus", "F", "until").select("o_orderkey", "o_orderstatus")


@query("SELECT n_nationkey, n_name, CAST(count(s_suppkey) AS INTEGER) AS n_children, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS names FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL")
def a5_parents_with_children(spark, sf):
    out = L.with_children(load(spark, sf, "nation"), load(spark, sf, "supplier"), "n_nationkey", "s_nationkey", "s_suppkey")
    return out.select("n_nationkey", "n_name", F.size("children").alias("n_children"), F.array_join(F.transform("children", lambda c: c["s_name"]), ",").alias("names"))


@query("SELECT p_partkey, p_name, n_name FROM part JOIN supplier ON p_partkey % 100 = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1")
def a6_component_details(spark, sf):
    part, supplier, nation = (load(spark, sf, t) for t in ("part", "supplier", "nation"))
    some = nation.filter("n_regionkey = 1")
    found = L.component_details(part.withColumn("owner", F.col("p_partkey") % 100), supplier, some, ("owner", "s_suppkey"), ("s_nationkey", "n_nationkey"))
    return found.select("p_partkey", "p_name", "n_name")


@query(
    """WITH changes AS (SELECT * FROM (SELECT o_custkey AS c_custkey, o_orderstatus AS c_mktsegment, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey, o_orderstatus, o_orderkey FROM orders WHERE o_custkey % 3 = 0)) WHERE r = 1)
SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN changes n ON c.c_custkey = n.c_custkey"""
)
def a7_upsert(spark, sf):
    base = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.lit(0).cast("long").alias("v"))
    key = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey"))
    changes = load(spark, sf, "orders").filter("o_custkey % 3 = 0").select(key.alias("c_custkey"), F.col("o_orderstatus").alias("c_mktsegment"), F.col("o_orderkey").alias("v"))
    return L.upsert(base, changes, ["c_custkey"], "v").select("c_custkey", "c_mktsegment")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def a8_last_wins(spark, sf):
    return L.last_wins(load(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "value")


@query("SELECT c_custkey, coalesce(status, 'unknown') AS status FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS status FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def a9_status_lookup(spark, sf):
    cache = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("status"))
    return L.status_of(load(spark, sf, "customer").select("c_custkey"), cache, "c_custkey")


@query(
    """SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'first' END, CASE WHEN p_partkey % 2 = 0 THEN 'second' END, 'none') AS origin,
CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 2 = 0 THEN 2 END AS INTEGER) AS source_rank FROM part"""
)
def a22_fallback_chain(spark, sf):
    part = load(spark, sf, "part").select("p_partkey")
    first, second = (part.filter(F.col("p_partkey") % n == 0).withColumn("origin", F.lit(name)) for n, name in ((3, "first"), (2, "second")))
    return L.first_found(part, "p_partkey", [first, second], "origin", "none")


@query("SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING min(doc_id) >= 100")
def a23_store_new_content(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    stored = docs.filter("doc_id < 100").select(F.sha2("text", 256).alias("content_hash"))
    new = L.store_new(docs.filter("doc_id >= 100"), stored, "text").select("content_hash")
    return docs.select(F.sha2("text", 256).alias("content_hash")).join(new, "content_hash", "left_semi").groupBy("content_hash").agg(F.count("*").alias("n"))


@query("SELECT name, CAST(source AS INTEGER) AS source FROM (SELECT name, source, row_number() OVER (PARTITION BY lower(name) ORDER BY source, name) AS r FROM (SELECT upper(p_name) AS name, 1 AS source FROM part UNION ALL SELECT p_name, 0 FROM part WHERE p_size < 20)) WHERE r = 1")
def a24_discover_names(spark, sf):
    part = load(spark, sf, "part")
    return L.discover([part.filter("p_size < 20").select(F.col("p_name").alias("name")), part.select(F.upper("p_name").alias("name"))], "name")


# Predicates and parametric search

_FACT_SQL = """facts AS (
  SELECT l_partkey AS component_id, l_orderkey * 10 + l_linenumber AS parameter_id, 'en' AS symbol, l_discount AS value_min, l_quantity AS value_typ, l_quantity AS value_max FROM lineitem
  UNION ALL SELECT l_partkey, l_orderkey * 10 + l_linenumber, 'tol', l_tax, l_discount, l_tax FROM lineitem
  UNION ALL SELECT l_partkey, l_orderkey * 10 + l_linenumber, 'PSRR', l_quantity, l_tax, l_discount FROM lineitem)"""
_REQUIRED = {"noise_nV_rtHz": "<2", "tolerance_pct": ">=0.08", "psrr_dB": "==50"}


@query(
    f"""WITH {_FACT_SQL} SELECT p_partkey AS component_id, p_name FROM part WHERE p_size > 5
AND EXISTS (SELECT 1 FROM facts f WHERE f.component_id = p_partkey AND symbol = 'en' AND value_typ < 2)
AND EXISTS (SELECT 1 FROM facts f WHERE f.component_id = p_partkey AND symbol = 'tol' AND value_max >= 0.08)
AND EXISTS (SELECT 1 FROM facts f WHERE f.component_id = p_partkey AND symbol = 'PSRR' AND value_min = 50)
ORDER BY p_partkey LIMIT 20"""
)
def b3_parametric_search(spark, sf):
    parts = load(spark, sf, "part").select(F.col("p_partkey").alias("component_id"), "p_name", "p_size")
    return P.parametric_search(parts, _facts(spark, sf), _REQUIRED, active=F.col("p_size") > 5).select("component_id", "p_name")


@query("SELECT p_partkey AS component_id FROM part WHERE p_size > 5 ORDER BY 1 LIMIT 20")
def b4_no_requirements(spark, sf):
    parts = load(spark, sf, "part").select(F.col("p_partkey").alias("component_id"), "p_size")
    return P.parametric_search(parts, _facts(spark, sf), {}, active=F.col("p_size") > 5).select("component_id")


@query(
    f"""WITH {_FACT_SQL}, v AS (SELECT component_id, symbol, CASE symbol WHEN 'en' THEN value_typ ELSE value_max END AS value, parameter_id FROM facts WHERE symbol IN ('en', 'tol')),
first AS (SELECT component_id, symbol, min_by(value, parameter_id) AS value FROM v GROUP BY 1, 2)
SELECT p_partkey AS component_id, max(CASE symbol WHEN 'en' THEN value END) AS noise, max(CASE symbol WHEN 'tol' THEN value END) AS tolerance, CAST(1 + 2 - count(symbol) AS INTEGER) AS n_missing FROM part LEFT JOIN first ON component_id = p_partkey GROUP BY 1"""
)
def b5_matched_attributes(spark, sf):
    parts = load(spark, sf, "part").select(F.col("p_partkey").alias("component_id"))
    out = P.matched_attributes(parts, _facts(spark, sf, place=True), ["noise_nV_rtHz", "tolerance_pct", "absent"], order=("parameter_id", "_file", "_row"))
    return out.select("component_id", F.try_element_at("matched", F.lit("noise_nV_rtHz")).alias("noise"), F.try_element_at("matched", F.lit("tolerance_pct")).alias("tolerance"), F.size("missing").alias("n_missing"))


@query("SELECT event_id, props FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NULL OR abs(try_cast(json_extract_string(props, '$.k') AS DOUBLE) - 50) <= 10")
def b6_frequency_tolerance(spark, sf):
    return load(spark, sf, "events").filter(P.within_tolerance(F.get_json_object("props", "$.k"), 50.0)).select("event_id", "props")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'error') AND event_type NOT IN ('error')")
def b7_methodology_filter(spark, sf):
    return load(spark, sf, "events").filter(P.methodology_filter(["click", "view", "error"], ["error"], F.col("event_type"))).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' AND o_totalprice >= 300000) OR lower(o_orderpriority) LIKE '%urgent%'")
def b15_axiom_language(spark, sf):
    orders = load(spark, sf, "orders")
    rule = {"any_of": [{"all_of": ["o_orderstatus == P", "o_totalprice >= 300000"]}, "o_orderpriority contains URGENT", "nothing == 1"]}
    return orders.filter(P.axiom(rule, orders.columns)).select("o_orderkey")


# Joins


@query("SELECT s_nationkey, a.s_suppkey AS s_suppkey_a, b.s_suppkey AS s_suppkey_b FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) > 2000")
def c9_apart_pairs(spark, sf):
    return J.apart_pairs(load(spark, sf, "supplier"), ["s_nationkey"], "s_suppkey", "s_acctbal", 2000.0).select("s_nationkey", "s_suppkey_a", "s_suppkey_b")


@query("SELECT c_nationkey, c_mktsegment, min(c_acctbal) AS low, max(c_acctbal) AS high, count(c_acctbal) AS n FROM customer GROUP BY ALL HAVING max(c_acctbal) - min(c_acctbal) > 9000")
def c10_conflicting_groups(spark, sf):
    return J.conflicting_groups(load(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal", 9000.0)


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag FROM lineitem)
SELECT a.l_suppkey AS a, b.l_suppkey AS b, string_agg(DISTINCT a.l_returnflag, ',' ORDER BY a.l_returnflag) AS labels FROM m a JOIN m b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY ALL"""
)
def c12_co_occurrence(spark, sf):
    return _co_occurrence(load(spark, sf, "lineitem"))


def _co_occurrence(rows):
    return J.co_occurrence(rows, "l_orderkey", "l_suppkey", "l_returnflag").select("a", "b", F.array_join("labels", ",").alias("labels"))


@query("WITH f AS (SELECT o_orderkey, o_custkey, 'sheet' AS origin FROM orders WHERE o_orderstatus = 'F') SELECT * FROM f UNION ALL SELECT o_orderkey, o_custkey, 'graph' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM f)")
def c13_priority_merge(spark, sf):
    orders = load(spark, sf, "orders")
    of = lambda rows, name: rows.select("o_orderkey", "o_custkey", F.lit(name).alias("origin"))
    return L.priority_merge(of(orders.filter("o_orderstatus = 'F'"), "sheet"), of(orders, "graph"), ["o_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)")
def c14_orphans(spark, sf):
    return L.orphans(load(spark, sf, "lineitem"), load(spark, sf, "part").filter("p_size <> 7"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber")


@query(
    """WITH r AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS lo, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size + 2 END AS hi FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b FROM r a JOIN r b ON a.p_partkey < b.p_partkey AND coalesce(a.lo, a.hi) <= coalesce(b.hi, b.lo) AND coalesce(b.lo, b.hi) <= coalesce(a.hi, a.lo)"""
)
def c18_range_overlap(spark, sf):
    return _range_overlap(load(spark, sf, "part"))


def _range_overlap(part):
    rows = part.select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("lo"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") + 2).alias("hi"))
    return J.overlapping_pairs(rows, "p_partkey", "lo", "hi", 2.0)


@query("SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice BETWEEN p_retailprice * 100 AND p_retailprice * 100 + 50")
def c22_range_join(spark, sf):
    return _range_join(spark, sf, load(spark, sf, "orders"))


def _range_join(spark, sf, orders):
    points = orders.select("o_orderkey", "o_totalprice")
    ranges = load(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("low"), (F.col("p_retailprice") * 100 + 50).alias("high"))
    return J.range_join(points, ranges, "o_totalprice", "low", "high", 200.0).select("o_orderkey", "p_partkey")


@query(
    """WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey % 100) AS u, greatest(l_suppkey, l_partkey % 100) AS v FROM lineitem WHERE l_suppkey <> l_partkey % 100)
SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.v = y.u JOIN e z ON z.u = x.u AND z.v = y.v"""
)
def c23_triangles(spark, sf):
    return J.triangles(_supply_edges(load(spark, sf, "lineitem")))


def _supply_edges(rows):
    return rows.select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") % 100).alias("v"))


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS s, 1000000 + l_partkey AS p FROM lineitem), k AS (SELECT s_suppkey AS node, s_nationkey % 3 AS kind FROM supplier)
SELECT a.s AS x1, a.p AS x2, b.s AS x3 FROM e a JOIN e b USING (p) JOIN k x ON x.node = a.s JOIN k y ON y.node = b.s WHERE x.kind = 0 AND y.kind = 1 AND a.s <> b.s"""
)
def c23_induced_chain(spark, sf):
    edges = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1000000).alias("v"))
    kinds = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 3).alias("kind"))
    parts = load(spark, sf, "part").select((F.col("p_partkey") + 1000000).alias("node"), F.lit(9).alias("kind"))
    return J.chain_motif(edges, kinds.unionByName(parts), [0, 9, 1])


@query("SELECT e.event_id, (SELECT arg_max(p.value, p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_value FROM events e WHERE e.event_type = 'error'")
def ext_as_of_join(spark, sf):
    events = load(spark, sf, "events")
    left = events.filter("event_type = 'error'").select("user_id", "event_id", "ts")
    right = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("last_value"))
    return J.nearest_before(left, right, ["user_id"], "ts", "at", "last_value").select("event_id", "last_value")


# Aggregates


@query(
    f"""WITH {_FACT_SQL} SELECT symbol, count(DISTINCT component_id) AS n_with, (SELECT count(*) FROM part WHERE p_size > 5) AS n_active, round(count(DISTINCT component_id) / (SELECT count(*) FROM part WHERE p_size > 5), 4) AS coverage FROM facts WHERE value_typ > 0.05 GROUP BY 1"""
)
def d1_coverage(spark, sf):
    return L.coverage(load(spark, sf, "part"), _facts(spark, sf).filter("value_typ > 0.05"), "p_partkey", "component_id", "symbol", F.col("p_size") > 5)


@query(
    """SELECT p_brand, greatest(0.0, least(1.0, round(sum(p_size / 100.0 * w) / sum(w), 4))) AS score FROM (SELECT p_brand, CAST(p_size AS DOUBLE) AS p_size, CASE WHEN p_name LIKE '%widget%' THEN 2.0 WHEN p_name LIKE '%ring%' THEN 0.5 ELSE 1.0 END AS w FROM part) GROUP BY 1"""
)
def d2_weighted_mean(spark, sf):
    weight = A.keyed_value(F.col("p_name"), {"widget": 2.0, "ring": 0.5}, 1.0)
    return A.weighted_mean(load(spark, sf, "part"), ["p_brand"], F.col("p_size").cast("double") / 100.0, weight)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def d4_arg_max(spark, sf):
    return A.arg_max(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("SELECT CAST(k AS INTEGER) AS l_linenumber, count(l_orderkey) AS n FROM range(1, 12) r(k) LEFT JOIN lineitem ON l_linenumber = k GROUP BY 1")
def d6_filled_counts(spark, sf):
    return A.filled_counts(load(spark, sf, "lineitem"), "l_linenumber", 1, 11)


@query("SELECT printf('kg-v%d.%d', (SELECT count(*) FROM customer), (SELECT count(*) FROM orders)) AS version")
def d7_version_string(spark, sf):
    return A.version_string(load(spark, sf, "customer"), load(spark, sf, "orders"))


@query("SELECT c_custkey, round(coalesce(avg(floor(o_totalprice)), 0.5), 4) AS mean_price FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1")
def d8_mean_or_default(spark, sf):
    joined = load(spark, sf, "customer").join(load(spark, sf, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.round(A.mean_or(F.floor("o_totalprice"), 0.5), 4).alias("mean_price"))


@query(
    """WITH a AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, event_type = 'purchase' AS passed, value AS score FROM events),
p AS (SELECT task_id, bool_or(passed AND attempt = 1) AS first, bool_or(passed AND attempt <= 3) AS any3, max(CASE WHEN attempt = 1 THEN score END) AS score FROM a GROUP BY 1)
SELECT count(*) AS n_tasks, round(avg(CASE WHEN first THEN 1.0 ELSE 0.0 END), 4) AS pass_at_1, round(avg(CASE WHEN any3 THEN 1.0 ELSE 0.0 END), 4) AS pass_at_n, round(avg(score), 4) AS mean_first_score FROM customer LEFT JOIN p ON task_id = c_custkey"""
)
def d13_pass_rates(spark, sf):
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    results = load(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.row_number().over(over).alias("attempt"), (F.col("event_type") == "purchase").alias("passed"), F.col("value").alias("score"))
    return A.pass_rates(load(spark, sf, "customer").select(F.col("c_custkey").alias("task_id")), results, 3)


@query("WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), t AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000) SELECT count(*) FILTER (f.k IS NOT NULL AND t.k IS NOT NULL) AS true_positives, round(count(*) FILTER (f.k IS NOT NULL AND t.k IS NOT NULL) / count(f.k), 4) AS precision, round(count(*) FILTER (f.k IS NOT NULL AND t.k IS NOT NULL) / count(t.k), 4) AS recall FROM f FULL JOIN t ON f.k = t.k")
def d24_precision_recall(spark, sf):
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus", "o_totalprice")
    return A.precision_recall(orders.filter("o_orderstatus = 'P'"), orders.filter("o_totalprice > 300000"), ["k"])


@query("SELECT o_custkey, round(CAST(sum((o_orderstatus <> 'P')::INT + (o_totalprice >= 100000)::INT) AS DOUBLE) / (count(*) * 2), 4) AS filled FROM orders GROUP BY 1")
def d20_field_coverage(spark, sf):
    orders = load(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", 1).alias("a"), F.when(F.col("o_totalprice") >= 100000, 1).alias("b"))
    return orders.groupBy("o_custkey").agg(F.round(A.fill_ratio(["a", "b"]), 4).alias("filled"))


@query("SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) AS entries FROM (SELECT user_id, event_type AS k, CAST(arg_max(event_id, ts) AS VARCHAR) AS v FROM events GROUP BY ALL) GROUP BY 1")
def d27_merged_maps(spark, sf):
    rows = load(spark, sf, "events").select("user_id", "ts", F.create_map("event_type", F.col("event_id").cast("string")).alias("m"))
    return A.merged_maps(rows, ["user_id"], "m", "ts").select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("entries"))


# Ranks and islands


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def e1_top_n(spark, sf):
    return R.top_n(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@query("SELECT p_partkey, pre || row_number() OVER (PARTITION BY p_brand, pre ORDER BY p_partkey) AS ref FROM (SELECT p_partkey, p_brand, CASE WHEN p_name LIKE '%res%' THEN 'R' WHEN p_name LIKE '%ind%' THEN 'L' WHEN p_name LIKE '%led%' THEN 'D' ELSE 'U' END AS pre FROM (SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN 'chip_resistor' WHEN 1 THEN 'power_inductor' WHEN 2 THEN 'led' ELSE 'mcu' END AS p_name FROM part))")
def e2_designators(spark, sf):
    n = F.col("p_partkey") % 4
    bom = load(spark, sf, "part").select("p_partkey", "p_brand", F.when(n == 0, "chip_resistor").when(n == 1, "power_inductor").when(n == 2, "led").otherwise("mcu").alias("kind"))
    return R.designators(bom, "p_brand", "kind", "p_partkey").select("p_partkey", "ref")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def e3_latest(spark, sf):
    return R.latest(load(spark, sf, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query(
    """WITH p AS (SELECT event_type AS kind, user_id AS part, avg(value) AS m, count(*) AS n FROM events GROUP BY ALL), q AS (SELECT *, sum(n) OVER (PARTITION BY kind) AS nk FROM p)
SELECT kind, part, round(m, 6) AS mean_score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(m, 9) DESC, part) AS r FROM q WHERE nk >= 3) WHERE r <= 2"""
)
def e4_preferred_parts(spark, sf):
    history = load(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("part"), "value")
    return R.preferred(history, "kind", "part", "value").select("kind", "part", F.round("mean_score", 6).alias("mean_score"), "rank")


@query(
    """WITH s AS (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM s)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM r GROUP BY 1, 2"""
)
def e6_islands(spark, sf):
    return R.islands(load(spark, sf, "events"), ["user_id"], "event_id", "event_type")


@query(
    """WITH g AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), o AS (SELECT *, coalesce(sum((n + 2) * 5.0) OVER (PARTITION BY l_orderkey ORDER BY l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM g)
SELECT l_orderkey, pos, CAST((row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY pos) - 1) * 5.0 + off AS DOUBLE) AS x FROM (SELECT l_orderkey, l_returnflag, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey AS pos FROM lineitem) JOIN o USING (l_orderkey, l_returnflag)"""
)
def e10_positions(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("pos"))
    return R.positions(rows, "l_orderkey", "l_returnflag", "pos").select("l_orderkey", "pos", "x")


@query("SELECT user_id, event_type, event_id AS from_pin, nxt AS to_pin FROM (SELECT user_id, event_type, event_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nxt FROM events) WHERE nxt IS NOT NULL")
def e11_wires(spark, sf):
    return R.wires(load(spark, sf, "events"), "user_id", "event_type", "event_id", "event_id")


@query("SELECT event_id, CAST(sum(CASE WHEN gap <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM (SELECT *, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) AS gap FROM events)")
def ext_sessions(spark, sf):
    return R.sessions(load(spark, sf, "events"), "user_id", "ts", 3600).select("event_id", "session")


# Retrieval

_TERMS = ["the", "and", "license"]


@query(
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
SELECT doc_id, round(len(list_filter(w, lambda x: x IN ('the', 'and', 'license'))) / len(w), 9) AS rank_score FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'and') AND list_contains(w, 'license')
ORDER BY len(list_filter(w, lambda x: x IN ('the', 'and', 'license'))) / len(w) DESC, doc_id LIMIT 20"""
)
def j3_full_text_search(spark, sf):
    return V.text_search(load(spark, sf, "documents"), _TERMS, "doc_id", "text").select("doc_id", F.round("rank_score", 9).alias("rank_score"))


def _vector(spark, sf) -> list[float]:
    return load(spark, sf, "embeddings").filter("vec_id = 0").first().embedding


@query(
    """WITH q AS (SELECT embedding AS x FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(s, 4) AS similarity FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(x AS DOUBLE[])) AS s FROM embeddings, q) WHERE s > 0.1 ORDER BY s DESC, vec_id LIMIT 20"""
)
def j4_vector_search(spark, sf):
    return V.vector_search(load(spark, sf, "embeddings"), _vector(spark, sf), "vec_id", "embedding", 0.1).select("vec_id", F.round("similarity", 4).alias("similarity"))


@query(
    """WITH q AS (SELECT embedding AS x FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(s, 4) AS similarity FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(x AS DOUBLE[])) AS s FROM embeddings, q WHERE label = 3) WHERE s > -1 ORDER BY s DESC, vec_id LIMIT 5"""
)
def b17_filtered_vector_search(spark, sf):
    return V.vector_search(load(spark, sf, "embeddings"), _vector(spark, sf), "vec_id", "embedding", -1.0, 5, F.col("label") == 3).select("vec_id", F.round("similarity", 4).alias("similarity"))


_RRF_SQL = """WITH l AS (
SELECT p_brand AS q, p_partkey AS id, 'size' AS layer, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_size > 10
UNION ALL SELECT p_brand, p_partkey, 'price', row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) FROM part WHERE p_size < 40),
f AS (SELECT q, id, sum(1.0 / (r + 60)) AS s, string_agg(layer, ',' ORDER BY layer) AS layers FROM l GROUP BY ALL)
SELECT q AS p_brand, id AS p_partkey, round(s, 9) AS final_score, layers, CAST(p AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, id) AS p FROM f) WHERE p <= 10"""


def _fused(spark, sf) -> DataFrame:
    part = load(spark, sf, "part")
    layers = V.ranked(part.filter("p_size > 10"), "size", F.col("p_size"), "p_partkey", "p_brand").unionByName(V.ranked(part.filter("p_size < 40"), "price", F.col("p_retailprice"), "p_partkey", "p_brand"))
    return V.fuse(layers, "p_partkey", "p_brand")


@query(_RRF_SQL)
def j6_rank_fusion(spark, sf):
    return _fused(spark, sf).select("p_brand", "p_partkey", F.round("final_score", 9).alias("final_score"), F.array_join("source_layers", ",").alias("layers"), "position")


@query(f"WITH r AS ({_RRF_SQL}) SELECT 'price' AS layer, count(*) FILTER (list_contains(string_split(layers, ','), 'price')) AS hits FROM r UNION ALL SELECT 'size', count(*) FILTER (list_contains(string_split(layers, ','), 'size')) FROM r UNION ALL SELECT 'other', 0")
def d14_layer_hits(spark, sf):
    return V.layer_hits(_fused(spark, sf), ["size", "price", "other"])


_HYBRID_SQL = f"""WITH {_FACT_SQL},
p1 AS (SELECT component_id AS id, 1.0 AS score FROM facts GROUP BY 1 HAVING bool_or(symbol = 'en' AND value_typ < 2) AND bool_or(symbol = 'tol' AND value_max >= 0.08)),
{ONE_SEARCH},
p2 AS (SELECT doc_id AS id, h / n AS score FROM hits),
q AS (SELECT embedding AS x FROM embeddings WHERE vec_id = 0),
p3 AS (SELECT vec_id AS id, s AS score FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(x AS DOUBLE[])) AS s FROM embeddings, q) WHERE s > 0.1),
p4 AS (SELECT s_suppkey AS id, 1.0 AS score FROM supplier WHERE s_name = 'Supplier#000000007' UNION ALL SELECT s_suppkey, 0.8 FROM supplier WHERE s_nationkey = 3),
l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r, 'parametric' AS layer FROM p1 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id), 'fts' FROM p2 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id), 'vector' FROM p3 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id), 'kg' FROM p4),
f AS (SELECT id, sum(1.0 / (r + 60)) AS s, string_agg(layer, ',' ORDER BY layer) AS layers FROM l WHERE r <= 20 GROUP BY 1)
SELECT id, round(s, 9) AS final_score, layers, CAST(p AS INTEGER) AS position FROM (SELECT *, row_number() OVER (ORDER BY round(s, 12) DESC, id) AS p FROM f) WHERE p <= 10"""


@query(_HYBRID_SQL)
def j7_hybrid_retrieval(spark, sf):
    return flagship(spark, sf)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval of items by number: facts of parts, texts of documents, vectors and role candidates, fused by rank."""
    conditions = P.predicates({"noise_nV_rtHz": "<2", "tolerance_pct": ">=0.08"})
    parametric = P.search(_facts(spark, sf_dir), conditions, "component_id").select(F.col("component_id").alias("id"), F.lit(1.0).alias("score"))
    asked = spark.createDataFrame([(0, "the works licensed")], "query_id int, query string")
    text = search_postings(build_postings(load(spark, sf_dir, "documents"), "doc_id", "text", stemmed=True), asked).select("id", F.col("rank_score").alias("score"))
    vector = V.vector_search(load(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), "vec_id", "embedding", 0.1).select(F.col("vec_id").alias("id"), F.col("similarity").alias("score"))
    roles = spark.createDataFrame([(1, "r", "Supplier#000000007", None), (1, "s", None, 3)], "pattern_id int, role string, part string, category int")
    components = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("component_id"), F.col("s_name").alias("part"), F.col("s_nationkey").alias("category"))
    related = N.role_candidates(roles, components).select(F.col("component_id").alias("id"), "score")
    found = hybrid(parametric, text, vector, related, "id")
    return found.select("id", F.round("final_score", 9).alias("final_score"), F.array_join("source_layers", ",").alias("layers"), "position")


# Graph

_EDGE_SQL = """edges AS (
  SELECT 'R' || n_regionkey AS s, 'N' || n_nationkey AS t, 0.95 AS c FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 0.6 + (c_custkey % 5) / 20.0 FROM customer
  UNION ALL SELECT 'N' || s_nationkey, 'C' || (s_suppkey * 7), 0.9 FROM supplier
  UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 0.55 + (o_orderkey % 9) / 20.0 FROM orders)"""


def _edges(spark, sf) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string") if isinstance(c, str) else c)
    of = lambda t, s, e, c: load(spark, sf, t).select(s.alias("source_id"), F.lit("REQUIRES").alias("relation"), e.alias("target_id"), c.cast("double").alias("confidence"))
    return (
        of("nation", name("R", "n_regionkey"), name("N", "n_nationkey"), F.lit(0.95))
        .unionByName(of("customer", name("N", "c_nationkey"), name("C", "c_custkey"), F.lit(0.6) + (F.col("c_custkey") % 5) / 20.0))
        .unionByName(of("supplier", name("N", "s_nationkey"), F.concat(F.lit("C"), (F.col("s_suppkey") * 7).cast("string")), F.lit(0.9)))
        .unionByName(of("orders", name("C", "o_custkey"), name("O", "o_orderkey"), F.lit(0.55) + (F.col("o_orderkey") % 9) / 20.0))
    )


@query(
    f"""WITH {_EDGE_SQL}, good AS (SELECT * FROM edges WHERE c >= 0.6), l1 AS (SELECT t AS id, max(c) AS p FROM good WHERE s = 'R1' GROUP BY 1),
l2 AS (SELECT t AS id, max(p * c) AS p FROM good JOIN l1 ON s = l1.id WHERE t <> 'R1' AND t NOT IN (SELECT id FROM l1) GROUP BY 1),
l3 AS (SELECT t AS id, max(p * c) AS p FROM good JOIN l2 ON s = l2.id WHERE t <> 'R1' AND t NOT IN (SELECT id FROM l1) AND t NOT IN (SELECT id FROM l2) GROUP BY 1)
SELECT id, CAST(depth AS INTEGER) AS depth, round(p, 9) AS confidence FROM (SELECT 'R1' AS id, 0 AS depth, 1.0 AS p UNION ALL SELECT id, 1, p FROM l1 UNION ALL SELECT id, 2, p FROM l2 UNION ALL SELECT id, 3, p FROM l3)"""
)
def i3_bounded_reach(spark, sf):
    start = spark.createDataFrame([("R1",)], "id string")
    return G.reach(_edges(spark, sf), start, 3)[0].select("id", "depth", F.round("confidence", 9).alias("confidence"))


@query(f"WITH {_EDGE_SQL} SELECT DISTINCT t AS id FROM edges WHERE s = 'N3' AND c >= 0.7")
def i1_neighbours(spark, sf):
    edges = _edges(spark, sf)
    nodes = edges.select(F.col("target_id").alias("id")).distinct()
    return G.neighbours(nodes, edges, spark.createDataFrame([("N3",)], "id string"), 0.7)


@query(
    f"""WITH {_EDGE_SQL}, n AS (SELECT 'C' || c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN ' ' ELSE c_name END AS label, c_acctbal / 8000 AS confidence FROM customer WHERE c_custkey % 10 <> 0)
SELECT 'orphan_source' AS problem, s || '->' || t AS key FROM edges WHERE s NOT IN (SELECT id FROM n) UNION ALL SELECT 'orphan_target', s || '->' || t FROM edges WHERE t NOT IN (SELECT id FROM n) UNION ALL SELECT 'edge_confidence', s || '->' || t FROM edges WHERE NOT c + 0.1 BETWEEN 0 AND 1
UNION ALL SELECT 'node_confidence', id FROM n WHERE NOT confidence BETWEEN 0 AND 1 UNION ALL SELECT 'blank_label', id FROM n WHERE trim(label) = ''"""
)
def i13_integrity(spark, sf):
    edges = _edges(spark, sf).withColumn("confidence", F.col("confidence") + 0.1)
    label = F.when(F.col("c_custkey") % 13 == 0, " ").otherwise(F.col("c_name"))
    nodes = load(spark, sf, "customer").filter("c_custkey % 10 <> 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), label.alias("label"), (F.col("c_acctbal") / 8000).alias("confidence"))
    return G.integrity(nodes, edges)


@query(
    """WITH n AS (SELECT 'R' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_name FROM customer)
SELECT a.id, a.name AS full_path, 0 AS depth FROM n a WHERE parent IS NULL UNION ALL SELECT b.id, a.name || '/' || b.name, 1 FROM n a JOIN n b ON b.parent = a.id WHERE a.parent IS NULL
UNION ALL SELECT c.id, a.name || '/' || b.name || '/' || c.name, 2 FROM n a JOIN n b ON b.parent = a.id JOIN n c ON c.parent = b.id WHERE a.parent IS NULL"""
)
def h37_tree_paths(spark, sf):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = load(spark, sf, "region").select(key("R", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nodes = nodes.unionByName(load(spark, sf, "nation").select(key("N", "n_nationkey").alias("id"), key("R", "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
    nodes = nodes.unionByName(load(spark, sf, "customer").select(key("C", "c_custkey").alias("id"), key("N", "c_nationkey").alias("parent"), F.col("c_name").alias("name")))
    return L.tree_paths(nodes, "id", "parent", "name")


# Rules


def _nets(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Nets and pins, both dealt by pin, so that neither making them distinct nor joining them deals them again."""
    li = load(spark, sf, "lineitem")
    nets = li.select(F.lit("d").alias("design_id"), F.concat(F.when(F.col("l_orderkey") % 2 == 0, "VCC_").otherwise("N"), F.col("l_orderkey").cast("string")).alias("net_name"), F.when(F.col("l_orderkey") % 2 == 0, "power").otherwise("signal").alias("net_type"), F.concat(F.lit("U"), F.col("l_partkey").cast("string")).alias("ref"), F.col("l_suppkey").cast("string").alias("pin_number")).repartition("ref", "pin_number").distinct()
    kind = F.col("pin_number").cast("int") % 4
    pins = nets.select("design_id", "ref", "pin_number").distinct().select("*", F.when(kind == 0, "output").when(kind == 1, "input").when(kind == 2, "io").otherwise("power").alias("pin_type"), F.when(kind == 3, F.when(F.col("pin_number").cast("int") % 3 == 0, "POWER_POSITIVE").otherwise("POWER_GROUND")).alias("function"), F.when(kind == 0, "SIGNAL_OUT").when(kind == 1, "SIGNAL_IN").when(kind == 3, "POWER_OUT").alias("role"))
    return nets, pins


_NET_SQL = """nets AS (SELECT DISTINCT 'd' AS design_id, CASE WHEN l_orderkey % 2 = 0 THEN 'VCC_' ELSE 'N' END || l_orderkey AS net_name, CASE WHEN l_orderkey % 2 = 0 THEN 'power' ELSE 'signal' END AS net_type, l_partkey AS ref, l_suppkey AS pin FROM lineitem),
p AS (SELECT net_name, net_type, count(*) FILTER (pin % 4 IN (0, 2)) AS outputs, bool_or(pin % 4 = 3 AND pin % 3 = 0) AS sourced, count(*) FILTER (pin % 4 IN (1, 2)) AS inputs FROM nets GROUP BY ALL)"""


@query(
    f"""WITH {_NET_SQL} SELECT 'no_output_conflict' AS rule, net_name AS subject FROM p WHERE outputs > 1 UNION ALL SELECT 'power_net_has_source', net_name FROM p WHERE net_name LIKE 'VCC%' AND NOT sourced UNION ALL SELECT 'no_floating_inputs', net_name FROM p WHERE net_type <> 'power' AND outputs = 0 AND inputs > 0"""
)
def k6_electrical_checks(spark, sf):
    return K.electrical_checks(*_nets(spark, sf)).select("rule", "subject")


@query(
    f"""WITH {_NET_SQL}, r AS (SELECT net_name, net_type, count(*) FILTER (pin % 4 = 0) AS so, count(*) FILTER (pin % 4 = 3) AS po, count(*) FILTER (pin % 4 <> 2) AS known FROM nets GROUP BY ALL)
SELECT 'driver_conflict' AS rule, net_name || ':SIGNAL_OUT' AS subject FROM r WHERE so > 1 UNION ALL SELECT 'driver_conflict', net_name || ':POWER_OUT' FROM r WHERE po > 1 UNION ALL SELECT 'power_undriven', net_name FROM r WHERE net_type = 'power' AND known > 0 AND po = 0"""
)
def k11_role_checks(spark, sf):
    return K.role_checks(*_nets(spark, sf))[0].select("rule", "subject")


@query(
    f"""WITH {_NET_SQL}, r AS (SELECT net_name, net_type, count(*) FILTER (pin % 4 = 0) AS so, count(*) FILTER (pin % 4 = 3) AS po, count(*) FILTER (pin % 4 <> 2) AS known FROM nets GROUP BY ALL),
t AS (SELECT sum(CASE WHEN net_type = 'power' THEN 3 ELSE 2 END) AS checked, sum((so > 1)::INT + (po > 1)::INT) AS critical, sum((net_type = 'power' AND known > 0 AND po = 0)::INT) AS warning FROM r)
SELECT 'd' AS design_id, CAST(checked AS BIGINT) AS checked, CAST(critical AS BIGINT) AS critical, CAST(warning AS BIGINT) AS warning, round(greatest(0.0, least(1.0, (checked - critical - 0.5 * warning) / CAST(checked AS DOUBLE))), 4) AS score FROM t"""
)
def d16_penalty_score(spark, sf):
    return K.scores(*K.role_checks(*_nets(spark, sf)))


@query(
    """SELECT user_id, round(greatest(0.0, least(1.0, sum(s * w) / sum(w))), 4) AS score FROM (SELECT user_id, 1 + event_id % 5 AS layer, avg(value) / 100 AS s FROM events GROUP BY ALL) JOIN (VALUES (1, 0.35), (2, 0.3), (3, 0.2), (4, 0.1), (5, 0.05)) v(layer, w) USING (layer) GROUP BY 1"""
)
def d17_layered_score(spark, sf):
    layers = load(spark, sf, "events").groupBy("user_id", (F.col("event_id") % 5 + 1).alias("layer")).agg((F.avg("value") / 100).alias("score"))
    return A.layered_score(layers, "user_id")


@query(
    """WITH p AS (SELECT l_partkey AS component_id, 'p' || l_linenumber AS name, CASE l_linenumber WHEN 1 THEN 'V_CC' WHEN 2 THEN 'PSRR' ELSE 'x' END AS symbol, l_discount * 300 AS lo, l_quantity AS typ, l_quantity * 1.5 AS hi, 1 - l_tax * 5 AS confidence FROM lineitem)
SELECT component_id, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (confidence < 0.7 OR lo > hi) AS failed, string_agg(DISTINCT name, ',' ORDER BY name) FILTER ((symbol = 'V_CC' AND (typ < 0.5 OR typ > 60 OR hi < 0.5 OR hi > 60)) OR (symbol = 'PSRR' AND (typ > 150 OR hi > 150))) AS warnings FROM p GROUP BY 1"""
)
def k1_quality_gate(spark, sf):
    n = F.col("l_linenumber")
    rows = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("component_id"), F.concat(F.lit("p"), n.cast("string")).alias("parameter_name"), F.when(n == 1, "V_CC").when(n == 2, "PSRR").otherwise("x").alias("symbol"), (F.col("l_discount") * 300).alias("value_min"), F.col("l_quantity").alias("value_typ"), (F.col("l_quantity") * 1.5).alias("value_max"), (1 - F.col("l_tax") * 5).alias("confidence"))
    text = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return K.quality_gate(rows).select("component_id", text("failed").alias("failed"), text("warnings").alias("warnings"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN lo > typ THEN 'min_above_typ' WHEN typ > hi THEN 'typ_above_max' WHEN typ IS NULL AND lo > hi THEN 'min_above_max' END AS problem
FROM (SELECT l_orderkey, l_linenumber, l_discount AS lo, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS typ, l_tax AS hi FROM lineitem) WHERE lo > typ OR typ > hi OR (typ IS NULL AND lo > hi)"""
)
def k2_ordering(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("value_min"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).alias("value_typ"), F.col("l_tax").alias("value_max"))
    return K.ordering_problems(rows).select("l_orderkey", "l_linenumber", "problem")


@query("SELECT c_custkey, 'balance' AS \"check\" FROM customer WHERE NOT c_acctbal >= 0 UNION ALL SELECT c_custkey, 'segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def k4_constraints(spark, sf):
    return K.check_constraints(load(spark, sf, "customer"), {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")}, "c_custkey")


@query(
    """SELECT o_orderkey, min_input_v, required_mw, string_agg(x, ',') AS conflicts FROM (SELECT o_orderkey, round(out + CASE o_orderstatus WHEN 'F' THEN 0.3 WHEN 'P' THEN 0 END, 6) AS min_input_v, out * ma AS required_mw, unnest([CASE WHEN sup < round(out + CASE o_orderstatus WHEN 'F' THEN 0.3 WHEN 'P' THEN 0 END, 6) THEN 'voltage_chain' END, CASE WHEN out * ma > budget THEN 'power_budget' END]) AS x
FROM (SELECT o_orderkey, o_orderstatus, CAST(o_orderkey % 12 AS DOUBLE) AS sup, CAST(o_custkey % 10 AS DOUBLE) AS out, CAST(o_orderkey % 500 AS DOUBLE) AS ma, o_totalprice / 200 AS budget FROM orders)) GROUP BY 1, 2, 3"""
)
def h39_interval_conflicts(spark, sf):
    topology = F.when(F.col("o_orderstatus") == "F", "ldo").when(F.col("o_orderstatus") == "P", "buck_converter").otherwise("unknown")
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("design_id"), topology.alias("topology"), (F.col("o_orderkey") % 12).cast("double").alias("supply_max_v"), (F.col("o_custkey") % 10).cast("double").alias("output_v"), (F.col("o_orderkey") % 500).cast("double").alias("output_ma"), (F.col("o_totalprice") / 200).alias("budget_mw"))
    return K.interval_conflicts(rows).select(F.col("design_id").alias("o_orderkey"), "min_input_v", "required_mw", F.nullif(F.array_join("conflicts", ","), F.lit("")).alias("conflicts"))


# Scalar functions


@query(
    r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '([0-9A-Za-z_])-[ \t\r]*\n\s*([0-9A-Za-z_])', '\1\2', 'g'), '\s+', ' ', 'g'))) AS text_hash FROM pages"""
)
def h21_clean_html(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.sha2(T.clean_html(F.col("html")), 256).alias("text_hash"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def h36_content_hash(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT n, CAST(greatest(10, least(1000, floor(sqrt(n)))) AS INTEGER) AS lists FROM (SELECT l_partkey * 1000 AS n FROM lineitem GROUP BY 1) WHERE n >= 10000")
def h38_index_lists(spark, sf):
    n = load(spark, sf, "lineitem").select((F.col("l_partkey") * 1000).alias("n")).distinct().filter("n >= 10000")
    return n.select("n", A.index_lists(F.col("n")).alias("lists"))


@query(
    """SELECT p_partkey, round(v * CASE u WHEN 'mV' THEN 1e-3 WHEN 'kohm' THEN 1e3 WHEN 'MHz' THEN 1e6 ELSE 1 END, 6) AS value, CASE u WHEN 'mV' THEN 'V' WHEN 'kohm' THEN 'Ω' WHEN 'MHz' THEN 'Hz' ELSE u END AS unit, u <> 'furlong' AS known
FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS v, CASE p_partkey % 5 WHEN 0 THEN 'mV' WHEN 1 THEN 'kohm' WHEN 2 THEN 'MHz' WHEN 3 THEN '°C' ELSE 'furlong' END AS u FROM part)"""
)
def h3_units(spark, sf):
    n = F.col("p_partkey") % 5
    unit = F.when(n == 0, "mV").when(n == 1, "kohm").when(n == 2, "MHz").when(n == 3, "°C").otherwise("furlong")
    q = load(spark, sf, "part").select("p_partkey", U.quantity(F.concat_ws(" ", F.col("p_size").cast("string"), unit)).alias("q"))
    return q.select("p_partkey", F.round("q.value", 6).alias("value"), "q.unit", "q.known")


@query("SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]\\s+'), lambda s: len(regexp_split_to_array(trim(s), '\\s+'))), lambda n: n BETWEEN 8 AND 60)) AS INTEGER) AS n_sentences FROM documents")
def b14_sentence_lengths(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_type || '!')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def h25_slugs(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_windowed_counts(spark, sf):
    from fathomgrid.streaming.review import windowed_counts

    return windowed_counts(load(spark, sf, "events"), "ts", "event_type", size="1 hour")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, sf):
    return load(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count("*").alias("n"))


# Knowledge, sources and the rest


#: span: what of two texts is left to match, and the size of the block that was found; common: all their common runs.
_BLOCK_SQL = """WITH RECURSIVE t AS (SELECT p_partkey AS axiom_id, p_brand AS implication, lower(p_name) AS requirement FROM part),
texts AS (SELECT DISTINCT requirement FROM t),
pairs AS (SELECT x.requirement AS a, y.requirement AS b FROM texts x, texts y),
common AS MATERIALIZED (SELECT * FROM (SELECT a, b, i, j, unnest(range(1, CAST(least(len(a) - i, len(b) - j) AS BIGINT) + 1)) AS k FROM (SELECT a, b, i, unnest(range(len(b))) AS j FROM (SELECT a, b, unnest(range(len(a))) AS i FROM pairs)) WHERE a[i + 1] = b[j + 1]) WHERE substr(a, i + 1, k) = substr(b, j + 1, k)),
span AS (
  SELECT a, b, 0::BIGINT AS a0, len(a)::BIGINT AS a1, 0::BIGINT AS b0, len(b)::BIGINT AS b1, 0::BIGINT AS size FROM pairs
  UNION ALL
  SELECT a, b, p.a0, p.a1, p.b0, p.b1, p.size FROM (
    SELECT a, b, unnest([{'a0': a0, 'a1': -best.i, 'b0': b0, 'b1': -best.j, 'size': best.k}, {'a0': best.k - best.i, 'a1': a1, 'b0': best.k - best.j, 'b1': b1, 'size': 0}]) AS p
    FROM (SELECT a, b, a0, a1, b0, b1, max({'k': k, 'i': -i, 'j': -j}) AS best FROM span JOIN common USING (a, b) WHERE i >= a0 AND i + k <= a1 AND j >= b0 AND j + k <= b1 GROUP BY a, b, a0, a1, b0, b1))),
alike AS (SELECT a, b, 2 * sum(size) / (len(a) + len(b)) AS ratio FROM span GROUP BY a, b)
SELECT x.implication, x.axiom_id AS a, y.axiom_id AS b, round(ratio, 6) AS ratio FROM t x JOIN t y ON x.implication = y.implication AND x.axiom_id < y.axiom_id JOIN alike ON alike.a = x.requirement AND alike.b = y.requirement WHERE ratio < 0.6"""


@query(_BLOCK_SQL)
def c11_axiom_conflicts(spark, sf):
    return _axiom_conflicts(load(spark, sf, "part"))


def _axiom_conflicts(part):
    axioms = part.select(F.col("p_partkey").alias("axiom_id"), F.col("p_brand").alias("implication"), F.col("p_name").alias("requirement"))
    return N.axiom_conflicts(axioms, digits=6)


@query("SELECT r.p_partkey AS pattern_id, s.s_suppkey AS component_id, 1.0 AS score FROM part r JOIN supplier s ON s.s_name = 'Supplier#' || lpad(CAST(r.p_partkey % 150 AS VARCHAR), 9, '0') WHERE r.p_partkey % 2 = 0 UNION ALL SELECT r.p_partkey, s.s_suppkey, 0.8 FROM part r JOIN supplier s ON s.s_nationkey = r.p_size WHERE r.p_partkey % 2 = 1")
def c4_role_candidates(spark, sf):
    even = F.col("p_partkey") % 2 == 0
    roles = load(spark, sf, "part").select(F.col("p_partkey").alias("pattern_id"), F.lit("r").alias("role"), F.when(even, F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 150).cast("string"), 9, "0"))).alias("part"), F.when(~even, F.col("p_size")).alias("category"))
    parts = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("component_id"), F.col("s_name").alias("part"), F.col("s_nationkey").alias("category"))
    # both scores are exact at one decimal, the type that the SQL gives them
    return N.role_candidates(roles, parts).select("pattern_id", "component_id", F.col("score").cast("decimal(2,1)").alias("score"))


@query(
    """WITH d AS (SELECT c_custkey AS design_id, c_acctbal / 50 - 60 AS t, c_nationkey % 2 = 0 AS single, c_mktsegment AS s FROM customer)
SELECT design_id, 'temperature_grade' AS rule, 'WARNING' AS severity FROM d WHERE t < -40 UNION ALL SELECT design_id, 'no_negative_rail', 'CRITICAL' FROM d WHERE single AND s = 'BUILDING' UNION ALL SELECT design_id, 'no_bypass', 'WARNING' FROM d WHERE s = 'MACHINERY' UNION ALL SELECT design_id, 'protection:esd', 'WARNING' FROM d WHERE s = 'HOUSEHOLD'"""
)
def k19_contradictions(spark, sf):
    segment = F.col("c_mktsegment")
    designs = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("design_id"),
        (F.col("c_acctbal") / 50 - 60).alias("temp_min_c"),
        F.when(F.col("c_nationkey") % 2 == 0, "single_dc").alias("supply_topology"),
        F.array(F.when(segment == "BUILDING", "zero_drift_op_amp").when(segment == "MACHINERY", "low_noise_ldo").otherwise("other")).alias("implications"),
        F.array(F.lit("plain")).alias("requirements"),
        F.when(segment == "HOUSEHOLD", F.array(F.lit("esd"))).alias("protections"),
    )
    return N.contradictions(designs)


@query("SELECT lower(replace(p_brand, '#', '_')) AS source_id, CASE p_size % 3 WHEN 0 THEN 'REQUIRES' ELSE 'USES' END AS relation, lower(p_type) AS target_id FROM part WHERE p_size % 3 < 2 AND p_size / 50.0 >= 0.65")
def b12_triples(spark, sf):
    n = F.col("p_size") % 3
    found = load(spark, sf, "part").select(F.col("p_brand").alias("subject"), F.when(n == 0, " Requires").when(n == 1, "uses").otherwise("eats").alias("verb"), F.col("p_type").alias("object"), (F.col("p_size") / 50.0).alias("confidence"))
    return N.triples(found).select("source_id", "relation", "target_id")


@query("SELECT event_type AS outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 4) AS share FROM events GROUP BY 1")
def e12_outcome_summary(spark, sf):
    return N.outcome_summary(load(spark, sf, "events").select(F.col("event_type").alias("outcome")))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def e9_capped_history(spark, sf):
    return N.capped_history(load(spark, sf, "events"), 500, "ts", "event_id").select("event_id")


@query("SELECT c_nationkey AS design_id, count(*) AS n, min(c_acctbal / 10000) AS lowest FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal / 10000 < 0.85 GROUP BY 1")
def k18_layout_gate(spark, sf):
    rows = load(spark, sf, "customer").select(F.col("c_nationkey").alias("design_id"), (F.col("c_mktsegment") == "BUILDING").alias("hard"), (F.col("c_acctbal") / 10000).alias("confidence"))
    return N.layout_gate(rows)


@query("SELECT c_custkey, CASE WHEN c < 0.3 THEN 'BLOCK' WHEN c < 0.7 OR seg = 'BUILDING' THEN 'WARN' ELSE 'PASS' END AS verdict FROM (SELECT c_custkey, c_acctbal / 10000 AS c, c_mktsegment AS seg FROM customer)")
def k5_verdict(spark, sf):
    flags = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return load(spark, sf, "customer").select("c_custkey", K.verdict(F.col("c_acctbal") / 10000, flags).alias("verdict"))


#: A heading that each pattern was written for, once with and once without blanks.
_HEADINGS = [p.replace(r"\s*.*", " x ").replace(r"\s*", gap) for patterns in T.SECTIONS.values() for p in patterns for gap in (" ", "")]
_HEADING_SQL = "CASE p_partkey % 4 WHEN 0 THEN '6.3 ' || upper(h) WHEN 1 THEN h || ' (' || p_name || ')' WHEN 2 THEN p_name || ' of ' || h ELSE p_type || ' ' || p_name END"


@query(
    f"""WITH headings AS (SELECT p_partkey, {_HEADING_SQL} AS heading FROM part, (SELECT [{", ".join(f"'{h}'" for h in _HEADINGS)}] AS all_h), LATERAL (SELECT all_h[CAST(p_partkey % len(all_h) + 1 AS BIGINT)] AS h)),
rules AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{name}', '{p}')" for i, (name, patterns) in enumerate(T.SECTIONS.items()) for p in patterns)}) r(i, name, pattern))
SELECT p_partkey, coalesce(arg_min(name, i), 'OTHER') AS section FROM headings LEFT JOIN rules ON regexp_matches(heading, pattern, 'i') GROUP BY 1"""
)
def h11_ordered_classifier(spark, sf):
    h = F.element_at(F.array(*map(F.lit, _HEADINGS)), (F.col("p_partkey") % len(_HEADINGS) + 1).cast("int"))
    return load(spark, sf, "part").withColumn("h", h).select("p_partkey", T.section(F.expr(_HEADING_SQL)).alias("section"))


@query("SELECT p_partkey, p_name || CASE WHEN p_name LIKE '%ring%' AND p_name NOT LIKE '%hoop%' THEN ' hoop' ELSE ' ' END AS expanded FROM part")
def h1_query_expansion(spark, sf):
    return load(spark, sf, "part").select("p_partkey", V.expand_query(F.col("p_name"), [["ring", "hoop"]]).alias("expanded"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size * 1000.0 WHEN p_size % 3 = 0 THEN p_size / 1000.0 ELSE CAST(p_size AS DOUBLE) END AS value FROM part")
def h4_numbers(spark, sf):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit("k"))).when(F.col("p_size") % 3 == 0, F.concat(size, F.lit(" m"))).otherwise(F.concat(F.lit("about "), size))
    return load(spark, sf, "part").select("p_partkey", F.round(U.number(text), 6).alias("value"))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 99 END, o_orderkey LIMIT 50")
def f5_priority_order(spark, sf):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").when(F.col("o_orderpriority") == "2-HIGH", "HIGH")
    return load(spark, sf, "orders").orderBy(V.priority_rank(rank), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@query("SELECT id AS p_partkey, 3 AS tier, (label LIKE '%small%')::INT + (label LIKE '%gear%')::INT AS hits FROM (SELECT p_partkey AS id, p_name AS label FROM part) WHERE label LIKE '%small%' OR label LIKE '%gear%' ORDER BY hits DESC, id LIMIT 5")
def f6_goal_match(spark, sf):
    nodes = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return G.match_goal(nodes, "a_very_small_zzz_gear").select(F.col("id").alias("p_partkey"), "tier", "hits")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1")
def g7_first_wins_dedup(spark, sf):
    return R.top_n(load(spark, sf, "documents").withColumn("h", F.md5("text")), ["h"], [F.col("source"), F.col("doc_id")], 1).select("doc_id", "source")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def g6_set_difference(spark, sf):
    orders = load(spark, sf, "orders")
    return orders.filter("o_orderstatus = 'F'").select("o_custkey").subtract(orders.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def g5_set_intersection(spark, sf):
    orders = load(spark, sf, "orders")
    return orders.filter("o_orderstatus = 'F'").select("o_custkey").intersect(orders.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 2")
def e8_best_per_section(spark, sf):
    return R.top_n(load(spark, sf, "events"), ["user_id", "event_type"], [F.col("value").desc(), F.col("event_id")], 2).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, round(avg(c), 4) AS confidence FROM (SELECT user_id, unnest([value / 100, event_id % 10 / 10.0]) AS c FROM events) GROUP BY 1")
def d23_values_confidence(spark, sf):
    rows = load(spark, sf, "events").select("user_id", (F.col("value") / 100).alias("a"), (F.col("event_id") % 10 / 10.0).alias("b"))
    return A.values_confidence(rows, ["user_id"], ["a", "b"])


@query("SELECT count(*) AS n_docs, count(*) FILTER (len(text) > 1000) AS n_long, sum(n_chars)::BIGINT AS n_chars FROM documents")
def d25_import_totals(spark, sf):
    return A.import_totals(load(spark, sf, "documents"), {"n_chars": F.col("n_chars")}, {"n_long": F.length("text") > 1000}).withColumnRenamed("n_rows", "n_docs")


@query("SELECT conv_id, string_agg(role || ':' || turn, ',' ORDER BY turn) AS turns FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def d26_ordered_nested(spark, sf):
    rows = A.ordered_nested(load(spark, sf, "conversations").filter("text IS NOT NULL"), ["conv_id"], "turn", "role", "t")
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["role"], x["turn"].cast("string"))), ",").alias("turns"))


@query("SELECT user_id, CASE WHEN decided IS NULL THEN 'pending' ELSE decided END AS status, CAST(greatest(n - 1, 0) AS BIGINT) AS refused FROM (SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (event_type IN ('click', 'error')) AS decided, count(*) FILTER (event_type IN ('click', 'error')) AS n FROM events GROUP BY 1)")
def l4_review_states(spark, sf):
    from fathomgrid.streaming.review import states

    status = F.when(F.col("event_type").isin("click", "error"), F.col("event_type")).otherwise("pending")
    log = load(spark, sf, "events").select(F.col("user_id").alias("item_id"), F.lit("d").alias("design_id"), F.lit("s").alias("stage"), status.alias("status"), F.lit("").alias("payload"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    return states(log).select(F.col("item_id").alias("user_id"), "status", "refused")


@query("SELECT c_custkey AS item FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j8_missing_to_review(spark, sf):
    from fathomgrid.streaming.review import missing_to_queue

    wanted = load(spark, sf, "customer").select(F.lit("d").alias("design_id"), F.col("c_custkey").alias("component_type"))
    found = load(spark, sf, "orders").filter("o_totalprice > 200000").select(F.lit("d").alias("design_id"), F.col("o_custkey").alias("component_type"))
    return missing_to_queue(wanted, found, "2024-01-01 00:00:00").select(F.col("payload").alias("item"))


#: One to three tables a page with spans that vary; in every fifth page each table has another inside its last cell.
_PAGE_TABLE = "concat('text<table><tr><th rowspan=\"', 2 + t % 2, '\">T', t, '</th><td colspan=', 1 + page_id % 2, '> ', u, '<tr><td>', n, CASE WHEN page_id % 5 = 0 THEN '<table><td> in </table>' ELSE '' END, '</td></tr></table>')"


@query(
    """WITH p AS (SELECT page_id, regexp_replace(url, '[^a-z0-9]', 'x', 'g') AS u, CAST(length(html) AS VARCHAR) AS n, unnest(range(page_id % 3 + 1)) AS t FROM pages), k AS (SELECT *, CAST(CASE WHEN page_id % 5 = 0 THEN 2 * t ELSE t END AS INTEGER) AS no FROM p)
SELECT page_id AS grid_id, no AS "table", 0 AS row, 0 AS col, 'T' || t AS text, true AS is_header, CAST(2 + t % 2 AS INTEGER) AS rowspan, 1 AS colspan FROM k UNION ALL SELECT page_id, no, 0, 1, u, false, 1, CAST(1 + page_id % 2 AS INTEGER) FROM k
UNION ALL SELECT page_id, no, 1, 1, n, false, 1, 1 FROM k UNION ALL SELECT page_id, no + 1, 0, 0, 'in', false, 1, 1 FROM k WHERE page_id % 5 = 0"""
)
def a20_html_tables(spark, sf):
    from fathomgrid.sources.readers import html_cells

    pages = load(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[^a-z0-9]", "x").alias("u"), F.length("html").alias("n"), F.explode(F.sequence(F.lit(0), F.pmod("page_id", F.lit(3)))).alias("t"))
    made = pages.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", F.expr(_PAGE_TABLE).alias("h")))), lambda x: x["h"]), "<p>").alias("made"))
    return html_cells(made, "page_id", "made")


#: Up to three tables a text, of one to four rows.
@query(
    """WITH t AS (SELECT doc_id, unnest(range(doc_id % 3 + 1)) AS t, source, n_chars FROM documents), b AS (SELECT *, unnest(range((doc_id + t) % 4)) AS r FROM t)
SELECT doc_id AS grid_id, CAST(t AS INTEGER) AS "table", 0 AS row, c AS col, CASE c WHEN 0 THEN 'id' ELSE 'n' || t END AS text, true AS is_header FROM t, (VALUES (0), (1)) v(c)
UNION ALL SELECT doc_id, CAST(t AS INTEGER), CAST(r + 1 AS INTEGER), c, CASE c WHEN 0 THEN source ELSE CAST(n_chars + r AS VARCHAR) END, false FROM b, (VALUES (0), (1)) v(c)"""
)
def a19_markdown_tables(spark, sf):
    from fathomgrid.sources.readers import markdown_cells

    line = "concat('| ', source, ' | ', n_chars + r, ' |')"
    one = f"concat('head\\n| id | n', t, ' |\\n|---|:-:|\\n', array_join(CASE WHEN (doc_id + t) % 4 = 0 THEN array() ELSE transform(sequence(0L, (doc_id + t) % 4 - 1), r -> {line}) END, '\\n'))"
    made = F.expr(f"array_join(transform(sequence(0L, doc_id % 3), t -> {one}), '\\ntail\\n')")
    return markdown_cells(load(spark, sf, "documents").select("doc_id", made.alias("made")), "doc_id", "made")


_PIN_SQL = """WITH p AS (SELECT CAST(user_id AS VARCHAR) AS design_id, event_id % 20 AS net, CASE event_type WHEN 'error' THEN 'NC' WHEN 'click' THEN 'POWER_OUT' WHEN 'view' THEN 'SIGNAL_OUT' END AS role FROM events),
n AS (SELECT design_id, net, count(*) AS pins, greatest(count(*) FILTER (role = 'POWER_OUT') - 1, 0) + greatest(count(*) FILTER (role = 'SIGNAL_OUT') - 1, 0) + CASE WHEN count(*) > 1 THEN count(*) FILTER (role = 'NC') ELSE 0 END AS bad FROM p GROUP BY ALL),
q AS (SELECT design_id, sum(pins) AS n_pins, greatest(0.0, (2 * count(*) - sum(bad)) / (2.0 * count(*))) AS score FROM n GROUP BY 1)"""


@query(_PIN_SQL + " SELECT design_id, round_even(score, 4) AS score FROM q")
def l1_quality(spark, sf):
    from fathomgrid.operators.search import qualities

    return qualities(_netlists(spark, sf))


def _repaired(spark, sf, how) -> DataFrame:
    """For each design what must hold of any repair: its pins are all there and it is no worse."""
    from fathomgrid.operators.search import measured, qualities

    pins = _netlists(spark, sf)
    after = measured(how(pins)).withColumnRenamed("score", "after")
    return qualities(pins).join(after, "design_id").select("design_id", "n_pins", (F.col("after") >= F.col("score")).alias("no_worse"))


@query(_PIN_SQL + " SELECT design_id, CAST(n_pins AS BIGINT) AS n_pins, true AS no_worse FROM q")
def l1_annealing_holds(spark, sf):
    from fathomgrid.operators.search import anneal

    return _repaired(spark, sf, anneal)


@query(_PIN_SQL + " SELECT design_id, CAST(n_pins AS BIGINT) AS n_pins, true AS no_worse FROM q")
def l2_beam_holds(spark, sf):
    from fathomgrid.operators.beam import beam

    return _repaired(spark, sf, beam)


@query()
def l1_annealing(spark, sf):
    from fathomgrid.operators.search import anneal, qualities

    return qualities(anneal(_netlists(spark, sf)))


@query()
def l2_beam_search(spark, sf):
    from fathomgrid.operators.beam import beam
    from fathomgrid.operators.search import qualities

    return qualities(beam(_netlists(spark, sf)))


#: s: the states of a level, up to three a design, by the numbers of their moved pins; a net of two pins has no conflict without one of them, a larger one has one less.
_BEAM_SQL = """WITH RECURSIVE p AS (SELECT CAST(user_id AS VARCHAR) AS design_id, 'N' || (event_id % 20) AS net, 'U' || (event_id % 7) AS ref, CAST(event_id AS VARCHAR) AS pin, CASE event_type WHEN 'error' THEN 'NC' WHEN 'click' THEN 'POWER_OUT' WHEN 'view' THEN 'SIGNAL_OUT' END AS role FROM events),
w AS (SELECT *, count(*) OVER (PARTITION BY design_id, net) AS n, row_number() OVER (PARTITION BY design_id, net, role ORDER BY ref, pin) AS k FROM p),
start AS (SELECT design_id, count(DISTINCT net) AS nets, count(*) FILTER ((role = 'NC' AND n > 1) OR (role IN ('POWER_OUT', 'SIGNAL_OUT') AND k > 1)) AS bad FROM w GROUP BY 1),
s AS (
  SELECT design_id, 0 AS level, 1 AS place, []::VARCHAR[] AS moved, nets, bad, greatest(0.0::DOUBLE, (2 * nets - bad) / (2.0::DOUBLE * nets)) AS score, greatest(0.0::DOUBLE, (2 * nets - bad) / (2.0::DOUBLE * nets)) AS best FROM start
  UNION ALL
  SELECT design_id, level + 1, CAST(rank AS INTEGER), list_append(moved, pin), nets, bad, score, greatest(best, max(score) OVER (PARTITION BY design_id)) FROM (
    SELECT *, row_number() OVER (PARTITION BY design_id ORDER BY score DESC, place, k) AS rank FROM (
      SELECT design_id, level, place, moved, pin, best, k, nets + 1 AS nets, bad - gone AS bad, greatest(0.0::DOUBLE, (2 * (nets + 1) - (bad - gone)) / (2.0::DOUBLE * (nets + 1))) AS score FROM (
        SELECT *, CASE WHEN n = 2 THEN on_net ELSE 1 END AS gone, row_number() OVER (PARTITION BY design_id, place ORDER BY first, ref, pin) AS k FROM (
          SELECT *, count(*) FILTER (hit) OVER (PARTITION BY design_id, place, net) AS on_net FROM (
            SELECT *, (role = 'NC' AND n > 1) OR (role IN ('POWER_OUT', 'SIGNAL_OUT') AND r > 1) AS hit FROM (
              SELECT s.*, net, ref, pin, role, count(*) OVER (PARTITION BY design_id, place, net) AS n, row_number() OVER (PARTITION BY design_id, place, net, role ORDER BY ref, pin) AS r, min({'r': ref, 'p': pin}) OVER (PARTITION BY design_id, place, net) AS first
              FROM s JOIN p USING (design_id) WHERE level < 4 AND best < 1 AND NOT list_contains(moved, pin))))
        WHERE hit) WHERE k <= 5)) WHERE rank <= 3)"""


@query(_BEAM_SQL + " SELECT design_id, round(score, 6) AS score, array_to_string(moved, ',') AS moves FROM s QUALIFY row_number() OVER (PARTITION BY design_id ORDER BY score DESC, level, place) = 1")
def l2_beam_states(spark, sf):
    from fathomgrid.operators.beam import beam_states

    return beam_states(_netlists(spark, sf)).select("design_id", F.round("score", 6).alias("score"), F.array_join(F.transform("moves", lambda m: m["pin"]), ",").alias("moves"))


def _netlists(spark, sf) -> DataFrame:
    role = F.when(F.col("event_type") == "error", "NC").when(F.col("event_type") == "click", "POWER_OUT").when(F.col("event_type") == "view", "SIGNAL_OUT")
    return load(spark, sf, "events").select(F.col("user_id").cast("string").alias("design_id"), F.concat(F.lit("N"), (F.col("event_id") % 20).cast("string")).alias("net"), F.concat(F.lit("U"), (F.col("event_id") % 7).cast("string")).alias("ref"), F.col("event_id").cast("string").alias("pin"), role.alias("role"))


from fathomgrid import domain_queries as _domain  # noqa: E402, F401  registers its queries
from fathomgrid import keyword_queries as _keywords  # noqa: E402, F401  registers its queries
from fathomgrid import search_queries as _search  # noqa: E402, F401  registers its queries
