"""Snapshots of a graph's tables that are there whole or not at all.

A version's tables are written to a folder of their own, which nothing reads yet. A manifest that
names the folder and counts the rows is written beside the log and moved into it by one
rename; that makes the version visible. An attempt that fails before leaves the log as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version string, folder string, n_nodes long, n_edges long, written_at timestamp"


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Rename unless the target exists; the file system decides between two at once."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    src, dst = hadoop.Path(source), hadoop.Path(target)
    files = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(dst.getParent())
    return not files.exists(dst) and files.rename(src, dst) and not files.exists(hadoop.Path(dst, src.getName()))


def history(spark: SparkSession, path: str) -> DataFrame:
    """The versions of the graph at ``path`` with their counts; none before the first."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).json(f"{path}/log")


def _known(spark: SparkSession, path: str, version: str) -> Row | None:
    return history(spark, path).filter(F.col("version") == version).first()


def commit_snapshot(nodes: DataFrame, edges: DataFrame, path: str, version: str) -> Row:
    """Write both tables as ``version`` and return its row of the log.

    A version that is there stays as it is, and its row is returned: to write one again does nothing.
    """
    spark = nodes.sparkSession
    found = _known(spark, path, version)
    if found:
        return found
    folder = f"{version}-{uuid.uuid4().hex}"
    counts = []
    for name, rows in (("nodes", nodes), ("edges", edges)):
        rows.write.parquet(f"{path}/data/{folder}/{name}")
        counts.append(spark.read.schema(rows.schema).parquet(f"{path}/data/{folder}/{name}").count())
    manifest = spark.createDataFrame([(version, folder, *counts)], "version string, folder string, n_nodes long, n_edges long").withColumn("written_at", F.current_timestamp())
    manifest.coalesce(1).write.json(f"{path}/open/{folder}")
    _moved(spark, f"{path}/open/{folder}", f"{path}/log/{version}")
    return _known(spark, path, version)


def restore_snapshot(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a version, by default the one written last; KeyError if there is none."""
    log = history(spark, path)
    row = (log.filter(F.col("version") == version) if version is not None else log.orderBy(F.col("written_at").desc(), F.col("version").desc())).first()
    if row is None:
        raise KeyError(version)
    return spark.read.parquet(f"{path}/data/{row.folder}/nodes"), spark.read.parquet(f"{path}/data/{row.folder}/edges")


def drop_unfinished(spark: SparkSession, path: str) -> int:
    """Delete the folders that no version names and return how many; not while a snapshot is being written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    kept = {r.folder for r in history(spark, path).select("folder").collect()}  # a row a version
    dropped = 0
    for part in ("data", "open"):
        at = hadoop.Path(f"{path}/{part}")
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for f in files.listStatus(at) if files.exists(at) else ():
            if f.getPath().getName() not in kept or part == "open":
                dropped += part == "data"
                files.delete(f.getPath(), True)
    return dropped
