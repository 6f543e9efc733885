"""Streaming ingest: check, route, dead letters; each micro-batch is written once however often it runs."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import contracts, routing
from tidemark.operators.dedup import within_watermark

DLQ = "raw_dlq_events"


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """New text files as raw records with coordinates: the file, the place where its split starts, and later (see write_batch) the line's
    number in the split, none of which a repeated batch changes."""
    s = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    return s.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("topic"), F.col("_metadata.file_block_start").alias("partition"), F.col("_metadata.file_modification_time").alias("ingested_at"))


def numbered(df: DataFrame) -> DataFrame:
    """df with offset, a row's number in its split of a file: rows of a split follow each other in a task."""
    rows = df.withColumn("offset", F.monotonically_increasing_id())
    first = rows.groupBy("topic", "partition").agg(F.min("offset").alias("__first"))  # a row for each split
    return rows.join(first, ["topic", "partition"]).withColumn("offset", F.col("offset") - F.col("__first")).drop("__first")


def write_batch(root: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink. Each table gets the folder batch=<id>, overwritten if the batch runs again: at-least-once input, one copy out."""

    def write(df: DataFrame, batch: int) -> None:
        if "offset" not in df.columns:
            df = numbered(df)
        checked = contracts.check(df.filter(F.trim("raw") != "")).persist()  # parsed once for all tables
        try:
            for name, rows in routing.route(checked).items():
                rows.sortWithinPartitions(*routing.SORT[name]).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
            dead = contracts.dead_letters(checked, "ingested_at", "topic", "partition", "offset")
            dead.sortWithinPartitions("reason_code", "ingested_at").write.mode("overwrite").parquet(f"{root}/{DLQ}/batch={batch}")
        finally:
            checked.unpersist()

    return write


def ingest(records: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Start a bounded run: all that is there, then stop. Offsets are committed after the tables are written."""
    return records.writeStream.foreachBatch(write_batch(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def raw_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All batches of a table; late events are never dropped here."""
    return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")


def deduplicated(records: DataFrame, key: str = "event_id", ts: str = "event_ts", delay: str = "3 hours") -> DataFrame:
    return within_watermark(records, key, ts, delay)


def run_to_end(query: StreamingQuery, stop: threading.Event | None = None, poll: float = 0.5) -> dict[str, float]:
    """Wait for a query, or until stop is set: then the batch that runs is finished and no other begins. Rows read, seconds, rows a second."""
    began = time.monotonic()
    while not query.awaitTermination(poll):
        if stop is not None and stop.is_set() and not query.status["isTriggerActive"]:
            query.stop()
    rows, took = sum(p["numInputRows"] for p in query.recentProgress), time.monotonic() - began
    return {"rows": rows, "seconds": took, "rows_per_second": rows / took if took else 0.0}
