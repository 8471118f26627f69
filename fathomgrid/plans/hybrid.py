"""Hybrid retrieval: parametric, full-text, vector and relation layers, fused by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.operators.retrieval import fuse, ranked


def hybrid(parametric: DataFrame, text: DataFrame, vector: DataFrame, related: DataFrame, id_col: str, query: str | None = None, depth: int = 20, limit: int = 10) -> DataFrame:
    """Fused candidates of the first ``depth`` of four layers ``id, score``; an empty layer adds nothing."""
    layers = None
    for name, rows in (("parametric", parametric), ("fts", text), ("vector", vector), ("kg", related)):
        part = ranked(rows, name, F.col("score"), id_col, query, depth)
        layers = part if layers is None else layers.unionByName(part)
    return fuse(layers, id_col, query, limit)
