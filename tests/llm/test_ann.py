"""Recall and order against brute force."""

import math

import numpy as np

from fathomgrid.llm.ann import directions, nearest


def brute(rows, every, k):
    good = [(i, x) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    out = {}
    for q, x in good:
        if q % every == 0:
            scored = sorted((-sum(np.float64(a) * b for a, b in zip(x, y, strict=True)), i) for i, y in good if i != q and len(y) == len(x))
            out[q] = scored[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, score int")


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 20, 20)
    for options in ({}, {"shard_rows": 200, "block_rows": 10}):
        got = nearest(df, **options).collect()
        assert len(got) == 20 * len(want)
        found = {q: {r.vec_id for r in got if r.query_id == q} for q in want}
        recall = sum(len(found[q] & {i for _, i in w}) for q, w in want.items()) / len(got)
        assert recall >= 0.9, recall
        for q in want:
            rows = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
            assert [r.rank for r in rows] == list(range(1, 21))
            assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)


def test_odd_rows_and_ties(spark):
    rng = np.random.default_rng(2)
    some = [(i, [float(v) for v in rng.normal(size=6).astype(np.float32)]) for i in range(1, 40)]
    rows = some + [(0, [1.0] * 6), (100, [2.0] * 6), (101, [2.0] * 6), (102, [2.0] * 6), (60, None), (61, [0.0] * 6), (62, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (63, [float("nan")] * 6), (64, [float("inf")] * 6), (None, [1.0] * 6), (80, [1.0, 2.0]), (65, []), (20, some[19][1])]
    rows = [(i, x) for i, x in rows if (i, x) not in some[19:20]] + [some[19]]
    got = nearest(frame(spark, rows)).collect()
    want = brute(rows, 20, 20)
    assert {r.query_id for r in got} == {0, 20, 100}
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)][:3] == [100, 101, 102]
    for r in got:
        assert r.vec_id != r.query_id and r.vec_id not in (60, 61, 62, 63, 64, 65, 80)
    assert len({r.vec_id for r in got if r.query_id == 0} & {i for _, i in want[0]}) >= 18
    assert nearest(frame(spark, rows[:0])).count() == 0
    assert nearest(frame(spark, [(0, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [-1.0, 0.0])])).count() == 2


def test_repeats_of_a_query_take_no_places(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(1, 60) if i % 20]
    rows += [(20, [9.0] * 6)] * 25
    for options in ({}, {"shard_rows": 30}, {"block_rows": 3}):
        got = nearest(frame(spark, rows), **options).collect()
        assert {r.query_id for r in got} == {20} and len(got) == 20, options
        assert 20 not in {r.vec_id for r in got}


def test_repeated_query_ids_with_other_vectors(spark):
    rows = [(20, [3.0, 1.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0, 3.0]), (7, [0.0, 5.0]), (8, [5.0, 0.0]), (9, [1.0, 1.0, 1.0])]
    got = sorted((r["rank"], r.vec_id, r.score) for r in nearest(frame(spark, rows)).collect())
    assert got == [(1, 7, 10.0), (2, 8, 5.0)]


def test_directions_are_units():
    d = directions(5, 12, 1)
    assert d.shape == (5, 12) and np.allclose((d**2).sum(0), 1)
