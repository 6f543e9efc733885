"""Readers of event files, tables and manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import event_time

#: Explicit, so that a file without clicks still has a rank column.
EVENT_SCHEMA = (
    "schema_version int, event_id string, event_type string, event_time string, session_id string, query string, client string, result_count int, rank int, doc_id string, "
    "order_id string, region_id string, experiment_variant string, cancel_reason string, dispatch_id string, rider_id string, result string, eta_minutes int, "
    "shipment_id string, device_id string, cargo_type string, leg string, temperature_c double, humidity_pct double"
)


def json_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (a file, folder or glob) with event_ts and event_date; rows without a time or a session are left out."""
    df = spark.read.schema(EVENT_SCHEMA).json(path)
    df = df.withColumn("event_ts", event_time("event_time")).withColumn("event_date", F.to_date("event_ts"))
    return df.filter(F.col("event_ts").isNotNull() & F.col("session_id").isNotNull())


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines for validation: raw, topic, partition, offset, ingested_at. The offset is only an order within a task's input."""
    df = spark.read.text(path).filter(F.trim("value") != "")
    return df.select(F.col("value").alias("raw"), F.lit("file").alias("topic"), F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), F.current_timestamp().alias("ingested_at"))


def parts(spark: SparkSession, path: str) -> DataFrame:
    """The part files of a folder; markers such as _SUCCESS are skipped; a missing folder raises FileNotFoundError."""
    try:
        return spark.read.json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def manifest(spark: SparkSession, path: str, field: str) -> DataFrame:
    """A list of a manifest document as rows."""
    doc = spark.read.option("multiLine", True).json(path)
    kind = doc.schema[field.split(".")[0]].dataType
    return doc.select(F.explode(field).alias("item")) if kind else doc


def kafka(spark: SparkSession, servers: str, topics: list[str], start: str = "earliest", most: int | None = None) -> DataFrame:
    """A stream of raw records where a Kafka connector is installed."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", start)
    r = r.option("maxOffsetsPerTrigger", most) if most else r
    return r.load().select(F.col("value").alias("raw"), "topic", "partition", "offset", F.col("timestamp").alias("ingested_at"))


def at_date(df: DataFrame, date: str, column: str = "event_date") -> DataFrame:
    """One date of a table partitioned by it: only that partition is scanned."""
    return df.filter(F.col(column) == F.lit(date).cast("date"))
