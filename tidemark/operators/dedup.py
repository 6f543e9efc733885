"""Deduplication: first arrival, latest version, order of input, and the bounded streaming form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Total arrival order of a log record.
ARRIVAL = ("ingested_at", "topic", "partition", "offset")


def _first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    # a filter on row_number = 1 becomes a group limit before the shuffle, so a hot key sends one row per task
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def first_arrival(df: DataFrame, key: str = "event_id", order: Sequence[str] = ARRIVAL) -> DataFrame:
    """Of rows with one key, the one that arrived first. Null keys identify nothing and are dropped; empty ones too."""
    known = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    return _first(df.filter(known), [key], [F.col(c).asc() for c in order])


def earliest(df: DataFrame, key: str = "event_id", ts: str = "event_ts", ties: Sequence[str] = ()) -> DataFrame:
    """Of rows with one key, the earliest by event time, with explicit tie-breaks."""
    return _first(df.filter(F.col(key).isNotNull()), [key], [F.col(ts).asc(), *(F.col(c).asc() for c in ties)])


def latest_version(df: DataFrame, keys: Sequence[str], version: str, ties: Sequence[str] = ()) -> DataFrame:
    """Replacing upsert at read: of rows with equal keys, the newest version."""
    return _first(df, keys, [F.col(version).desc(), *(F.col(c).desc() for c in ties)])


def within_watermark(df: DataFrame, key: str = "event_id", ts: str = "event_ts", delay: str = "3 hours") -> DataFrame:
    """Streaming dedup with state that expires after the delay. The batch recompute stays the source of truth."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def savings(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows, kept, dropped: what dedup by key removes."""
    per = df.groupBy(*key).agg(F.count("*").alias("n"))
    total, kept = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return per.agg(total.alias("rows"), kept.alias("kept"), (total - kept).alias("dropped"))
