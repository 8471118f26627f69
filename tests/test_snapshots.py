"""A snapshot is there whole or not at all."""

import pytest
from pyspark.sql import functions as F

from fathomgrid.operators.snapshots import commit_snapshot, drop_unfinished, history, restore_snapshot


def tables(spark, n):
    return spark.range(n).selectExpr("cast(id as string) as id"), spark.range(n - 1).selectExpr("cast(id as string) as source_id", "cast(id + 1 as string) as target_id")


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/graph"
    assert history(spark, path).count() == 0
    with pytest.raises(KeyError):
        restore_snapshot(spark, path)
    first = commit_snapshot(*tables(spark, 5), path, "v1")
    assert (first.n_nodes, first.n_edges) == (5, 4)

    nodes, edges = tables(spark, 9)
    with pytest.raises(Exception, match="half-way"):  # the second table fails after the first was written
        commit_snapshot(nodes, edges.withColumn("bad", F.raise_error(F.lit("half-way")).cast("string")), path, "v2")
    assert [r.version for r in history(spark, path).collect()] == ["v1"]
    assert restore_snapshot(spark, path)[0].count() == 5
    with pytest.raises(KeyError):
        restore_snapshot(spark, path, "v2")

    second = commit_snapshot(nodes, edges, path, "v2")
    assert (second.n_nodes, second.n_edges) == (9, 8)
    again = commit_snapshot(*tables(spark, 3), path, "v2")
    assert again == second and history(spark, path).count() == 2
    assert [restore_snapshot(spark, path, v)[0].count() for v in ("v1", "v2")] == [5, 9]
    assert restore_snapshot(spark, path)[1].count() == 8
    assert drop_unfinished(spark, path) == 1 and drop_unfinished(spark, path) == 0
    assert [restore_snapshot(spark, path, v)[1].count() for v in ("v1", "v2")] == [4, 8]
