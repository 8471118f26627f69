"""SimHash fingerprints of word shingles and the documents that they link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components
from .vptree import links


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles, repeats included; of the whole sequence if it is shorter.

    Words are separated by ASCII white space, A-Z is lower-cased.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.array([], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True) if len(words) > k else [(0, len(line))]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; without hashes none is."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16_384):
        part = hashes[at : at + 16_384]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row of ``docs(doc_id, text)``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, fp long")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked if their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest doc_id reachable. Copies share a fingerprint, and only
    distinct fingerprints are compared. Null and empty texts have fingerprint zero and
    are linked like any other. Rows with a null id are kept and take part; a component
    of nothing else has a null component_id. No rows give no rows; other columns are
    ignored.
    """
    rows = materialise(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shingle))
    values = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(values, radius, **options))
    placed = values.join(roots, values["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(placed.join(named, "root").select(F.col("fp").alias("value"), "component_id"))
    out = rows.join(classes, rows["fp"] == classes["value"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
