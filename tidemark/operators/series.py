"""Gaps and islands in keyed time series, with one shuffle by key and one sort for both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import seconds


def with_steps(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """df with before_ts and step_seconds, the whole seconds since the row before of the same key."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    return df.withColumns({"before_ts": F.lag(ts).over(w), "step_seconds": seconds(ts) - F.lag(seconds(ts)).over(w)})


def gaps(df: DataFrame, key: str, ts: str, tie: str, limit_seconds: int, cadence_seconds: int) -> DataFrame:
    """Steps longer than the limit: key, after, before, missing_minutes (the step without one cadence, whole minutes)."""
    step = with_steps(df, key, ts, tie).filter(F.col("step_seconds") > limit_seconds)
    missing = F.floor((F.col("step_seconds") - cadence_seconds) / 60).cast("long")
    return step.select(key, F.col("before_ts").alias("after"), F.col(ts).alias("before"), missing.alias("missing_minutes"))


def islands(df: DataFrame, key: str, ts: str, tie: str, inside: Column, limit_seconds: int, aggregates: Sequence[Column]) -> DataFrame:
    """Runs of rows where ``inside`` holds, broken by a row where it doesn't or by a step longer than the limit: key, island and aggregates."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    rows = with_steps(df, key, ts, tie).withColumn("__in", F.coalesce(inside, F.lit(False)))
    broken = ~F.col("__in") | F.col("step_seconds").isNull() | (F.col("step_seconds") > limit_seconds)
    rows = rows.withColumn("island", F.sum(broken.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a row outside opens the number that the rows inside after it share, so it is left out only now
    return rows.filter("__in").groupBy(key, "island").agg(*aggregates)
