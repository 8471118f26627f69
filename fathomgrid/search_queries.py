"""Registered queries of batched retrieval, many queries taken from the tables in one plan, and of what is written and read back."""

from __future__ import annotations

from contextlib import suppress
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.functions import text as T
from fathomgrid.functions.stemming import stems
from fathomgrid.operators import ivf
from fathomgrid.operators import knowledge as N
from fathomgrid.operators import parametric as P
from fathomgrid.operators import postings as I
from fathomgrid.operators.matching import find_phrases
from fathomgrid.operators.retrieval import STOP_WORDS, tokens
from fathomgrid.operators.snapshots import commit_snapshot, history, restore_snapshot
from fathomgrid.plans.hybrid import hybrid
from fathomgrid.registry import _FACT_SQL, _facts, query
from fathomgrid.session import load, scratch
from fathomgrid.sources.sinks import write_graphml
from fathomgrid.stem_sql import ONE_SEARCH, STOPPED, WORDS, stem_sql
from fathomgrid.streaming import review


@query(f"WITH words AS ({WORDS}), {stem_sql('words')} SELECT w AS word, stem FROM stemmed")
def h30_stems(spark: SparkSession, sf: str) -> DataFrame:
    words = load(spark, sf, "documents").select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", stems("word").alias("stem"))


@query(f"WITH {ONE_SEARCH} SELECT doc_id, round(h / n, 9) AS rank_score FROM hits ORDER BY h / n DESC, doc_id LIMIT 20")
def h30_stemmed_search(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame([(0, "the works licensed")], "query_id int, query string")
    found = I.search_postings(I.build_postings(load(spark, sf, "documents"), "doc_id", "text", stemmed=True), asked)
    return found.select(F.col("id").alias("doc_id"), F.round("rank_score", 9).alias("rank_score"))


# Batched searches: the queries are all runs of words of the benchmark's items

_RUNS_SQL = """SELECT CAST(item_id AS VARCHAR) || ':' || i AS query_id, item_id, i, w[i : i + {n} - 1] AS q
FROM (SELECT item_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM benchmark))"""


def _runs(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """query_id, item_id, i, query: each run of ``n`` words of an item."""
    items = load(spark, sf, "benchmark").select("item_id", tokens(F.col("text")).alias("w")).filter(F.size("w") >= n)
    rows = items.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    return rows.select(F.concat_ws(":", F.col("item_id").cast("string"), F.col("i").cast("string")).alias("query_id"), "item_id", F.col("i").cast("long").alias("i"), F.array_join(F.slice("w", F.col("i"), n), " ").alias("query"))


#: found: the first 20 texts of each query; postings and asked hold the terms.
_SEARCH_SQL = """p AS (SELECT doc_id, t, count(*) AS n FROM postings GROUP BY ALL),
sizes AS (SELECT doc_id, sum(n) AS size FROM p GROUP BY 1),
wanted AS (SELECT DISTINCT query_id, t FROM asked),
n_wanted AS (SELECT query_id, count(*) AS k FROM wanted GROUP BY 1),
hits AS (SELECT query_id, doc_id, sum(n) AS h, count(*) AS c FROM wanted JOIN p USING (t) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, h / size AS s FROM hits JOIN n_wanted USING (query_id) JOIN sizes USING (doc_id) WHERE c = k),
found AS (SELECT query_id, doc_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM scored QUALIFY rank <= 20)"""


@query(f"WITH words AS ({WORDS}), postings AS (SELECT doc_id, w AS t FROM words), runs AS ({_RUNS_SQL.format(n=3)}), asked AS (SELECT query_id, unnest(q) AS t FROM runs), {_SEARCH_SQL} SELECT query_id, doc_id, round(s, 9) AS rank_score, CAST(rank AS INTEGER) AS rank FROM found")
def j3_batched_search(spark: SparkSession, sf: str) -> DataFrame:
    index = I.build_postings(load(spark, sf, "documents"), "doc_id", "text")
    found = I.search_postings(index, _runs(spark, sf, 3).select("query_id", "query"))
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("rank_score", 9).alias("rank_score"), "rank")


def _stemmed_sql(n: int) -> str:
    return f"""words AS ({WORDS}), runs AS ({_RUNS_SQL.format(n=n)}), said AS (SELECT query_id, unnest(q) AS w FROM runs), everything AS (SELECT w FROM words UNION ALL SELECT w FROM said),
{stem_sql("everything")},
postings AS (SELECT doc_id, stem AS t FROM words JOIN stemmed USING (w) WHERE w NOT IN ({STOPPED})), asked AS (SELECT query_id, stem AS t FROM said JOIN stemmed USING (w) WHERE w NOT IN ({STOPPED})), {_SEARCH_SQL}"""


@query(f"WITH {_stemmed_sql(2)} SELECT query_id, doc_id, round(s, 9) AS rank_score, CAST(rank AS INTEGER) AS rank FROM found")
def j3_batched_stemmed_search(spark: SparkSession, sf: str) -> DataFrame:
    index = I.build_postings(load(spark, sf, "documents"), "doc_id", "text", stemmed=True)
    found = I.search_postings(index, _runs(spark, sf, 2).select("query_id", "query"))
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("rank_score", 9).alias("rank_score"), "rank")


@query(
    f"""WITH {_stemmed_sql(2)}, first AS (SELECT item_id, doc_id, min(struct_pack(i := i, s := s)) AS f FROM found JOIN runs USING (query_id) GROUP BY ALL)
SELECT item_id, doc_id, round(f.s, 9) AS relevance, CAST(row_number() OVER (PARTITION BY item_id ORDER BY f.s DESC, doc_id) AS INTEGER) AS position FROM first QUALIFY position <= 10"""
)
def f4_documents_by_design(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of each design, here an item, by the first of its queries that found them."""
    index, runs = I.build_postings(load(spark, sf, "documents"), "doc_id", "text", stemmed=True), _runs(spark, sf, 2)
    found = I.search_postings(index, runs.select("query_id", "query")).join(runs, "query_id")
    out = I.first_found(found.select(F.col("item_id").alias("design_id"), F.col("i").alias("query_pos"), "id", F.col("rank_score").alias("relevance")))
    return out.select(F.col("design_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("relevance", 9).alias("relevance"), "position")


# Vectors

_USABLE_SQL = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"


@query(
    f"""WITH v AS ({_USABLE_SQL})
SELECT query_id, vec_id, round(s, 4) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS INTEGER) AS rank
FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.x, b.x) AS s FROM v a, v b WHERE a.vec_id % 50 = 0) QUALIFY rank <= 20"""
)
def f2_all_lists_probed(spark: SparkSession, sf: str) -> DataFrame:
    """The search through the index with all of its lists probed: equal to a scan."""
    vectors = load(spark, sf, "embeddings")
    index = ivf.build_lists(vectors, "vec_id", "embedding")
    found = ivf.search_lists(index, vectors.filter("vec_id % 50 = 0"), "vec_id", "embedding", len(index.centres))
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 4).alias("similarity"), "rank")


@query("SELECT count(*) AS n_queries, true AS found_enough FROM embeddings WHERE vec_id % 50 = 0")
def f11_probed_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether four fifths of the lists hold nine tenths of the 20 nearest of every 50th vector."""
    vectors = load(spark, sf, "embeddings")
    index, asked = ivf.build_lists(vectors, "vec_id", "embedding"), vectors.filter("vec_id % 50 = 0")
    some, every = (ivf.search_lists(index, asked, "vec_id", "embedding", n).select("query_id", "id") for n in (-(-4 * len(index.centres) // 5), len(index.centres)))
    kept = every.join(some.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return kept.agg(F.count("*").alias("n_queries"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("found_enough"))


# Hybrid retrieval of a table of component queries

_CONDITIONS = "SELECT item_id AS query_id, 'en' AS symbol, 'value_typ' AS field, '<' AS op, CAST(1 + item_id % 5 AS DOUBLE) AS bound FROM {items} UNION ALL SELECT item_id, 'tol', 'value_max', '>=', 0.08D - (item_id % 3) / 100D FROM {items}"
_ROLES = "SELECT item_id AS query_id, 'Supplier#00000000' || CAST(item_id % 10 AS STRING) AS part, CAST(NULL AS INT) AS category FROM {items} UNION ALL SELECT item_id, NULL, CAST(item_id % 25 AS INT) FROM {items}"


def _duck(sql: str) -> str:
    return sql.replace("{items}", "benchmark").replace("STRING", "VARCHAR").replace("0.08D", "0.08::DOUBLE").replace("100D", "100::DOUBLE")


_BATCH_SQL = f"""WITH {_FACT_SQL}, conditions AS ({_duck(_CONDITIONS)}),
met AS (SELECT DISTINCT query_id, component_id, c.symbol FROM facts f JOIN conditions c USING (symbol) WHERE CASE op WHEN '<' THEN value_typ < bound ELSE value_max >= bound END),
parametric AS (SELECT query_id, component_id AS id, 1.0::DOUBLE AS score FROM met GROUP BY ALL HAVING count(*) = 2),
{_stemmed_sql(2)},
texts AS (SELECT item_id AS query_id, doc_id AS id, s AS score FROM found JOIN runs USING (query_id) WHERE i = 1),
v AS ({_USABLE_SQL}),
vectors AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.x, b.x) AS score FROM v a JOIN benchmark ON item_id = a.vec_id, v b WHERE list_cosine_similarity(a.x, b.x) > 0.1),
roles AS ({_duck(_ROLES)}),
related AS (SELECT query_id, s_suppkey AS id, 1.0::DOUBLE AS score FROM roles JOIN supplier ON s_name = part UNION ALL SELECT query_id, s_suppkey, 0.8 FROM roles JOIN supplier ON s_nationkey = category WHERE part IS NULL),
layers AS (SELECT 'parametric' AS layer, * FROM parametric UNION ALL SELECT 'fts', * FROM texts UNION ALL SELECT 'vector', query_id, id, round(score, 12) FROM vectors UNION ALL SELECT 'kg', * FROM related),
ranked AS (SELECT *, row_number() OVER (PARTITION BY layer, query_id ORDER BY score DESC, id) AS r FROM layers QUALIFY r <= 20),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (r + 60)) AS f, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers FROM ranked GROUP BY ALL)
SELECT query_id, id, round(f, 9) AS final_score, layers, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(f, 12) DESC, id) AS INTEGER) AS position FROM fused QUALIFY position <= 5"""


@query(_BATCH_SQL)
def j7_batched_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Four layers for every query of a table at once, fused by rank: the first five of each query.

    A query has two conditions on facts, two words, a vector and two roles, all from its item.
    """
    items = load(spark, sf, "benchmark").select("item_id")
    parametric = P.search_batch(_facts(spark, sf), spark.sql(_CONDITIONS, items=items)).select("query_id", F.col("component_id").alias("id"), F.lit(1.0).alias("score"))
    index = I.build_postings(load(spark, sf, "documents"), "doc_id", "text", stemmed=True)
    asked = _runs(spark, sf, 2).filter("i = 1").select(F.col("item_id").alias("query_id"), "query")
    texts = I.search_postings(index, asked).select("query_id", "id", F.col("rank_score").alias("score"))
    vectors = load(spark, sf, "embeddings")
    lists = ivf.build_lists(vectors, "vec_id", "embedding")
    near = ivf.search_lists(lists, vectors.join(items, F.col("item_id") == F.col("vec_id"), "left_semi"), "vec_id", "embedding", len(lists.centres), 20, 0.1).select("query_id", "id", F.round("similarity", 12).alias("score"))
    components = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("component_id"), F.col("s_name").alias("part"), F.col("s_nationkey").alias("category"))
    roles = spark.sql(_ROLES, items=items).select(F.col("query_id").alias("pattern_id"), F.lit("r").alias("role"), "part", "category")
    related = N.role_candidates(roles, components).select(F.col("pattern_id").alias("query_id"), F.col("component_id").alias("id"), "score")
    found = hybrid(parametric, texts, near, related, "id", "query_id", limit=5)
    return found.select("query_id", "id", F.round("final_score", 9).alias("final_score"), F.array_join("source_layers", ",").alias("layers"), "position")


# Phrases of all vocabularies in one pass

_VOCABULARIES = {"topology": T.TOPOLOGIES, "method": T.METHODS, "stop": {w: [w] for w in STOP_WORDS}}
_PHRASES_SQL = ", ".join(f"('{v}', '{t}', '{p}')" for v, terms in _VOCABULARIES.items() for t, phrases in terms.items() for p in phrases)


@query(
    f"""SELECT doc_id, vocabulary, term, phrase, CAST(CASE WHEN len(phrase) > 1 AND left(phrase, 1) = right(phrase, 1) THEN len(list_filter(range(len(low)), lambda i: substr(low, i + 1, len(phrase)) = phrase)) ELSE (len(low) - len(replace(low, phrase, ''))) // len(phrase) END AS BIGINT) AS n, CAST(strpos(low, phrase) - 1 AS BIGINT) AS first
FROM (SELECT doc_id, lower(text) AS low FROM documents), (VALUES {_PHRASES_SQL}) v(vocabulary, term, phrase) WHERE contains(low, phrase)"""
)
def h13_phrases_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    found = find_phrases(load(spark, sf, "documents"), "doc_id", "text", _VOCABULARIES)
    return found.withColumnRenamed("id", "doc_id")


# Snapshots and files of a graph


@query(
    """SELECT version, kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS key_sum FROM (
SELECT 'v1' AS version, 'nodes' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 'v1', 'edges', o_orderkey FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT 'v2', 'nodes', c_custkey FROM customer UNION ALL SELECT 'v2', 'nodes', s_suppkey FROM supplier UNION ALL SELECT 'v2', 'edges', o_orderkey FROM orders) GROUP BY ALL"""
)
def a28_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions written and restored, with an attempt at the second that fails after its nodes between them."""
    path = scratch(spark)
    customers = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    nodes, edges = customers.union(load(spark, sf, "supplier").select("s_suppkey")), load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    commit_snapshot(customers, edges.filter("o_orderstatus <> 'O'"), path, "v1")
    with suppress(PySparkException):
        commit_snapshot(nodes, edges.withColumn("o_orderstatus", F.raise_error(F.lit("no edges yet")).cast("string")), path, "v2")
    if history(spark, path).count() == 1:
        commit_snapshot(nodes, edges, path, "v2")
    parts = [rows.select(F.lit(v).alias("version"), F.lit(kind).alias("kind"), "k") for v in ("v1", "v2") for kind, rows in zip(("nodes", "edges"), restore_snapshot(spark, path, v), strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy("version", "kind").agg(F.count("*").alias("n"), F.sum("k").alias("key_sum"))


@query("SELECT 'node' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name || ' & <co \"x\"' AS value FROM part UNION ALL SELECT 'edge', p_partkey || '>' || p_size, CAST(p_size AS VARCHAR) FROM part")
def a10_graphml_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes and edges written as GraphML text and read back."""
    part, path = load(spark, sf, "part"), scratch(spark)
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    nodes = part.select(key.alias("id"), F.create_map(F.lit("v"), F.concat("p_name", F.lit(' & <co "x"'))).alias("properties"))
    edges = part.select(key.alias("source_id"), size.alias("target_id"), F.create_map(F.lit("v"), size).alias("properties"))
    write_graphml(nodes, edges, path)
    value = F.try_element_at("properties", F.lit("v")).alias("value")
    back = N.graphml(spark, f"{path}/nodes", "node").select(F.lit("node").alias("kind"), "id", value)
    return back.union(N.graphml(spark, f"{path}/edges", "edge").select(F.lit("edge"), F.concat_ws(">", "source", "target"), value))


# The review queue as a stream


@query(
    """WITH e AS (SELECT event_id % 700 AS item_id, CASE event_type WHEN 'click' THEN 'approved' WHEN 'error' THEN 'corrected' WHEN 'view' THEN 'rejected' ELSE 'pending' END AS status, event_id, user_id, ts FROM events)
SELECT CAST(item_id AS VARCHAR) AS item_id, CAST(arg_min(user_id, (ts, event_id)) AS VARCHAR) AS design_id, coalesce(arg_min(status, (ts, event_id)) FILTER (status <> 'pending'), 'pending') AS status,
arg_min(CAST(event_id AS VARCHAR), (ts, event_id)) FILTER (status <> 'pending') AS payload, greatest(count(*) FILTER (status <> 'pending') - 1, 0) AS refused FROM e GROUP BY 1"""
)
def l4_review_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All events, in order of time, through the stateful stream in four batches, with a restart from the checkpoint after two."""
    status = F.when(F.col("event_type") == "click", "approved").when(F.col("event_type") == "error", "corrected").when(F.col("event_type") == "view", "rejected").otherwise("pending")
    events = load(spark, sf, "events")
    log = events.select((F.col("event_id") % 700).cast("string").alias("item_id"), F.col("user_id").cast("string").alias("design_id"), F.lit("s").alias("stage"), status.alias("status"), F.col("event_id").cast("string").alias("payload"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_id").alias("seq"))
    first, last = log.agg(F.min(F.unix_micros("created_at")), F.max(F.unix_micros("created_at"))).first()
    quarter = F.floor((F.unix_micros("created_at") - first) * 4 / (last - first + 1))
    path = scratch(spark)
    review.use_rocksdb(spark)
    for part in range(4):
        log.filter(quarter == part).coalesce(1).write.mode("append").parquet(f"{path}/events")
        if part % 2:
            stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events")
            review.keep_states(review.lifecycle(stream), f"{path}/states", f"{path}/checkpoint").awaitTermination()
    return review.current_states(spark, f"{path}/states").select("item_id", "design_id", "status", "payload", "refused")
