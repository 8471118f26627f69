"""The inverted index and the vector lists against scans, and their rows without a value."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fathomgrid.operators import ivf, parametric, postings


def brute(docs, queries, limit):
    counts = {}
    for i, text in docs:
        if i is not None:
            counts.setdefault(i, Counter()).update("".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split())
    out = []
    for q, text in queries:
        terms = set("".join(c if c.isalnum() and c.isascii() else " " for c in (text or "").lower()).split())
        scored = sorted((-sum(c[t] for t in terms) / sum(c.values()), i) for i, c in counts.items() if terms and all(c[t] for t in terms))
        out += [(q, i, round(-s, 9), n) for n, (s, i) in enumerate(scored[:limit], 1)]
    return sorted(out)


def test_postings_equal_a_scan(spark):
    rng = random.Random(4)
    words = ["ab", "Cd", "e1", "the", "f", "é", "zz"]
    docs = [(i, " ".join(rng.choices(words, [9, 5, 3, 9, 1, 1, 1], k=rng.randint(0, 30)))) for i in range(120)] + [(None, "ab"), (7, None), (3, "ab zz zz"), (500, ""), (501, "the-the!the")]
    queries = [(f"q{i}", " ".join(rng.sample(words, rng.randint(1, 4)))) for i in range(40)] + [("none", ""), ("null", None), ("missing", "ab nowhere"), ("same", "the ab"), ("twice", "ab the ab")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as term", "2 as n", "3 as id")
    q = spark.createDataFrame(queries, "query_id string, query string").withColumn("term", F.lit(1))
    for limit in (20, 3):
        got = sorted((r.query_id, r.id, round(r.rank_score, 9), r.rank) for r in postings.search_postings(postings.build_postings(d, "doc_id", "text"), q, limit).collect())
        assert got == brute(docs, queries, limit)
    assert postings.search_postings(postings.build_postings(d.limit(0), "doc_id", "text"), q).count() == 0
    stemmed = postings.build_postings(d, "doc_id", "text", stemmed=True)
    assert postings.search_postings(stemmed, spark.createDataFrame([("a", "the"), ("b", "the abs")], "query_id string, query string")).select("query_id").distinct().collect() == [("b",)]


def test_first_found(spark):
    rows = spark.createDataFrame([(1, 2, 9, 0.9), (1, 1, 9, 0.3), (1, 5, 8, 0.3), (2, 1, 9, 0.1)], "design_id int, query_pos int, id int, relevance double")
    assert sorted(tuple(r) for r in postings.first_found(rows).collect()) == [(1, 8, 0.3, 1), (1, 9, 0.3, 2), (2, 9, 0.1, 1)]


def test_conditions_of_many_queries(spark):
    facts = spark.createDataFrame([(1, "en", 0.0, 1.0, 2.0), (1, "tol", 0.0, 5.0, 0.5), (2, "en", 0.0, 3.0, 3.0), (2, "tol", 0.0, 0.0, 0.1), (3, "en", None, None, None)], "component_id int, symbol string, value_min double, value_typ double, value_max double")
    wanted = [("a", "en", "value_typ", "<", 2.0), ("a", "tol", "value_max", ">=", 0.5), ("b", "en", "value_typ", ">", 2.0), ("b", "en", "value_typ", ">", 2.0), ("c", "en", "value_typ", "<", 9.0), ("d", "en", "value_typ", "<", None), ("d", "tol", "value_max", ">", 0.0), ("e", "en", "other", "<", 9.0), ("f", "en", "value_max", "==", 3.0)]
    got = parametric.search_batch(facts, spark.createDataFrame(wanted, "query_id string, symbol string, field string, op string, bound double"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("b", 2), ("c", 1), ("c", 2), ("f", 2)]


def scan(rows, asked, k):
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in rows}
    out = {}
    for q in asked:
        order = sorted((-round(float(unit[q] @ v), 9), i) for i, v in unit.items())
        out[q] = [i for _, i in order[:k]]
    return out


def test_lists_equal_a_scan_and_find_clusters(spark):
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(12, 16))
    rows = [(i, (middles[i % 12] + 0.15 * rng.normal(size=16)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ivf.build_lists(df, "vec_id", "embedding", lists=12, shard_rows=50)
    assert sum(index.shards.values()) >= 18 and index.rows.count() == 900
    asked = df.filter("vec_id % 50 = 0")
    want = scan(rows, [i for i, _ in rows if i % 50 == 0], 20)
    for probes, least in ((12, 1.0), (3, 0.9)):
        got = {}
        for r in sorted(ivf.search_lists(index, asked, "vec_id", "embedding", probes, block_rows=3).collect(), key=lambda r: r.rank):
            got.setdefault(r.query_id, []).append(r.id)
        assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= least * sum(map(len, want.values()))
        assert least < 1 or got == want


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [math.nan, 1.0]), (None, [1.0, 0.0]), (6, [2.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as list", "2 as x", "3 as shard")
    index = ivf.build_lists(df, "vec_id", "embedding", lists=3)
    got = ivf.search_lists(index, df, "vec_id", "embedding", 3, limit=3, threshold=0.5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.rank) for r in got] == [(1, 1, 1), (1, 6, 2), (1, 8, 3), (6, 1, 1), (6, 6, 2), (6, 8, 3), (7, 7, 1), (7, 8, 2), (7, 8, 3), (8, 8, 1), (8, 8, 2), (8, 1, 3)]
    nothing = ivf.build_lists(df.filter("vec_id = 2"), "vec_id", "embedding")
    assert ivf.search_lists(nothing, df, "vec_id", "embedding", 3).count() == 0


def test_centres_where_a_task_has_no_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "id long, x array<double>")
    sparse = df.repartition(2, "id").filter("id >= 0").union(df.filter("id < 0"))
    assert sparse.rdd.glom().map(len).collect().count(0)
    centres = ivf.fit_centres(sparse, 2, 3, 5)
    assert centres.shape == (2, 2) and abs((centres**2).sum(1) - 1).max() < 1e-9


def test_terms_are_counted_where_texts_are_read(spark):
    """Before terms are dealt nothing is sent; rows of one id are one text, stems and stop words included."""
    from pyspark.sql import functions as F

    from fathomgrid.operators.postings import _counted, build_postings

    docs = spark.createDataFrame([(1, "The Works, working"), (1, "worked on a"), (2, None), (3, "the"), (None, "works")], "id long, text string")
    assert "Exchange" not in _counted(docs, "id", F.col("text"), True)._jdf.queryExecution().executedPlan().toString()
    index = build_postings(docs, "id", "text", stemmed=True)
    assert [tuple(r) for r in index.postings.collect()] == [("work", 1, 3)]
    assert [tuple(r) for r in index.sizes.collect()] == [(1, 3)]


def test_sets_of_terms_go_in_parts(spark):
    """The same texts however few terms go at a time; a set's terms may stand in texts that its rarest term isn't in."""
    words = ["ash", "box", "cog", "dam", "elm", "fig"]
    docs = [(i, " ".join(w for j, w in enumerate(words) for _ in range(i % (j + 2)))) for i in range(60)]
    queries = [(f"q{i}{j}", f"{a} {b} {a}") for i, a in enumerate(words) for j, b in enumerate(words)] + [("one", "fig"), ("all", " ".join(words)), ("none", "fig yew"), ("no", "")]
    q, d = spark.createDataFrame(queries, "query_id string, query string"), spark.createDataFrame(docs, "doc_id long, text string")
    index = postings.build_postings(d, "doc_id", "text")
    for batch in (25, 1_000_000):
        got = sorted((r.query_id, r.id, round(r.rank_score, 9), r.rank) for r in postings.search_postings(index, q, 7, batch).collect())
        assert got == brute(docs, queries, 7)
