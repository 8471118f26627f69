"""Helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word of the licence and decontamination operators: digits, lower-case letters
#: and everything beyond ASCII; these are the characters that separate words.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

NOWHERE = 2**63 - 1  # the id of rows without one, where such rows come last
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000  # what is broadcast has no more of either


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is set in local mode, in which all
    tasks run on one machine; a cluster without it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="fathomgrid-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    Unlike ``checkpoint()`` this runs the plan once and keeps columnar statistics. The
    folder is deleted when the application ends.
    """
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    files, at = _folder(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    files, at = _folder(spark, path)
    files.delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null."""
    return F.translate(text, UPPER, LOWER)


def plain_words(text: Column) -> Column:
    """Words of a whole text (null: none) as the licence operator takes them."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), WORD_GAP), lambda w: w != "")


def _width(df: DataFrame) -> Column:
    """About the bytes of a row: eight a number, the length of strings and arrays of numbers."""
    sizes = {"string": lambda c: F.octet_length(c), "binary": lambda c: F.octet_length(c)}
    parts = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        parts.append(F.coalesce(sizes[kind](c), F.lit(0)) if kind in sizes else 8 * F.coalesce(F.size(c), F.lit(0)) if kind == "array" else F.lit(8))
    return sum(parts, F.lit(16)).cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and about ``size`` bytes."""
    found = df.agg(F.count("*").alias("rows"), F.sum(_width(df)).alias("size")).first()
    return found.rows <= rows and (found.size or 0) <= size


def sized_join(big: DataFrame, other: DataFrame, on: list[str] | Column, how: str) -> DataFrame:
    """Broadcast ``other`` if it is `small`, so that ``big`` isn't shuffled; else a plain join."""
    return big.join(F.broadcast(other) if small(other) else other, on, how)
