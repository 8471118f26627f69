"""Session and table helpers shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "fathomgrid", master: str | None = None, **conf: object) -> SparkSession:
    """A session with UTC time, AQE and a skew-aware join planner.

    ``master`` and cluster sizing are left to the deployment unless given; keyword
    arguments become ``spark.*`` settings with ``__`` standing for a dot.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read ``table`` from ``sf_dir``; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def load_in_order(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """``table`` with ``_file`` and ``_row``, each row's place in it, for choices that its own columns leave open."""
    return load(spark, sf_dir, table).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``, deleted when the application ends.

    Where the setting is absent a temporary folder is set in local mode; a cluster without it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="fathomgrid-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where}/part-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(rows: DataFrame) -> DataFrame:
    """``rows`` from a table at a `scratch` path, so that their plan runs once."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
