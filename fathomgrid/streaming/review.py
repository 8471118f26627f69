"""The review queue as an append-only event log: batch views, and the same as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Which status may follow which.
NEXT = {"pending": ("approved", "rejected", "corrected"), "approved": (), "rejected": (), "corrected": ()}


def states(events: DataFrame) -> DataFrame:
    """Current status of every item of ``events(item_id, design_id, stage, status, payload, created_at, seq)``.

    The first decision on a pending item counts; later ones are counted as refused.
    """
    order = Window.partitionBy("item_id").orderBy("created_at", "seq")
    numbered = events.withColumn("_n", F.row_number().over(order))
    per = numbered.groupBy("item_id").agg(
        F.min_by(F.struct("design_id", "stage", "created_at"), "_n").alias("o"),
        F.min_by(F.struct("status", "payload", F.col("created_at").alias("decided_at")), F.when(F.col("status") != "pending", F.col("_n"))).alias("d"),
        F.count_if(F.col("status") != "pending").alias("decisions"),
    )
    return per.select("item_id", "o.design_id", "o.stage", "o.created_at", F.coalesce("d.status", F.lit("pending")).alias("status"), "d.payload", "d.decided_at", F.greatest(F.col("decisions") - 1, F.lit(0)).alias("refused"))


def latest_for_stage(items: DataFrame) -> DataFrame:
    """The newest item of every design and stage."""
    order = Window.partitionBy("design_id", "stage").orderBy(F.col("created_at").desc(), F.col("item_id").desc())
    return items.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def resumable(items: DataFrame) -> DataFrame:
    """Designs and stages that may go on: the newest item was approved or corrected; a correction's payload takes the place of the item's own."""
    return latest_for_stage(items).filter(F.col("status").isin("approved", "corrected")).select("design_id", "stage", "status", F.when(F.col("status") == "corrected", F.col("payload")).alias("correction"))


def pending(items: DataFrame) -> DataFrame:
    return items.filter("status = 'pending'").orderBy(F.col("created_at").desc(), F.col("item_id").desc())


def missing_to_queue(wanted: DataFrame, found: DataFrame, at: str) -> DataFrame:
    """Events for component types ``design_id, component_type`` that a retrieval didn't find."""
    gone = wanted.join(found.select("design_id", "component_type").distinct(), ["design_id", "component_type"], "left_anti")
    return gone.select(F.sha2(F.concat_ws("|", "design_id", "component_type"), 256).alias("item_id"), "design_id", F.lit("retrieval").alias("stage"), F.lit("pending").alias("status"), F.col("component_type").alias("payload"), F.lit(at).cast("timestamp").alias("created_at"), F.lit(0).alias("seq"))


def follow(events: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of events to the log. A batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_ITEM = "design_id string, stage string, created_at timestamp, status string, payload string, decided_at timestamp, refused long"
_FIELDS = [f.split()[0] for f in _ITEM.split(", ")]
ITEM_STATE = f"item_id string, {_ITEM}"


class Lifecycle(StatefulProcessor):
    """One item's way through the review queue: a row of state, changed by events that may follow it.

    An event whose status may not follow the item's is counted as refused. With ``due``, an item that is
    pending when the watermark has passed its creation by so long becomes ``expired``, which nothing follows.
    """

    def __init__(self, due: timedelta | None) -> None:
        self.due = due

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", _ITEM)

    def _row(self, key: Any, item: dict[str, Any]) -> Iterator[pd.DataFrame]:
        self.item.update(tuple(item[f] for f in _FIELDS))
        yield pd.DataFrame([{"item_id": key[0], **item}])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["created_at", "seq"], kind="stable")
        item = dict(zip(_FIELDS, self.item.get(), strict=True)) if self.item.exists() else None
        for e in events.itertuples(index=False):
            at = e.created_at.to_pydatetime()
            if item is None:
                item = {"design_id": e.design_id, "stage": e.stage, "created_at": at, "status": "pending", "payload": None, "decided_at": None, "refused": 0}
                if self.due is not None:
                    self.handle.registerTimer(int((e.created_at + self.due).timestamp() * 1000))
            if e.status in NEXT.get(item["status"], ()):
                item |= {"status": e.status, "payload": e.payload, "decided_at": at}
            elif e.status != "pending":
                item["refused"] += 1
        yield from self._row(key, item)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        item = dict(zip(_FIELDS, self.item.get(), strict=True))
        if item["status"] == "pending":
            yield from self._row(key, item | {"status": "expired"})

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, due: timedelta | None = None, late: str = "1 hour") -> DataFrame:
    """The stream of item states, a row for each item that a batch changes, from a stream of events like those of `states`.

    An item's events must come in order of ``created_at, seq`` from batch to batch. State is kept by RocksDB, which the session
    must name (`use_rocksdb`). With ``due`` the stream has a watermark of ``late``; events behind it are dropped.
    """
    timed = events.withWatermark("created_at", late) if due is not None else events
    return timed.groupBy("item_id").transformWithStateInPandas(Lifecycle(due), ITEM_STATE, "Update", "EventTime" if due is not None else "None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def keep_states(changes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the changes of `lifecycle` to ``table``, a folder a batch, until there is no more input; goes on from the checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(spark: SparkSession, table: str) -> DataFrame:
    """Each item as the last batch that changed it left it."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy("item_id").agg(F.max_by(F.struct(*_FIELDS), "batch").alias("item"))
    return newest.select("item_id", "item.*")


def windowed_counts(events: DataFrame, time: str, kind: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts by window and kind with a watermark (an extension); works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
