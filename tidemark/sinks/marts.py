"""Mart writers: date-scoped overwrite, guards, per-day partition replacement, JSON lines and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mart:
    name: str
    columns: tuple[str, ...]
    date: str = "event_date"
    #: Order of the rows in a file, so that its column statistics prune.
    sort: tuple[str, ...] = ()


SEARCH_SESSION = Mart("mart_search_session", (
    "session_id", "event_date", "queries", "distinct_queries", "clicks", "click_rate", "distinct_query_ratio", "avg_gap_seconds", "min_gap_seconds", "stddev_gap_seconds", "avg_click_rank", "span_seconds",
    "queries_per_minute", "client", "first_query_at", "last_query_at",
), sort=("session_id",))
SEARCH_DAILY = Mart("mart_search_daily", ("event_date", "sessions", "queries", "clicks", "distinct_queries", "ctr"))
TOP_QUERY = Mart("mart_search_top_query", ("event_date", "rank", "query", "queries", "sessions", "clicks", "ctr"), sort=("rank",))
SESSION_ABUSE = Mart("mart_session_abuse", ("session_id", "event_date", "score", "is_abusive", "speed", "regularity", "monotony", "disinterest", "reasons", "threshold"), sort=("session_id",))
QUALITY_REPORT = Mart("mart_quality_report", ("run_date", "check_name", "passed", "observed", "expected"), "run_date", ("check_name",))


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def stray_dates(mart: Mart, df: DataFrame, dates: Sequence[str]) -> None:
    """Raise if a mart has a row of a date that isn't among the given ones."""
    own = F.coalesce(F.col(mart.date).cast("date").cast("string").isin(*dates), F.lit(False))
    other = df.filter(~own).select(F.col(mart.date).cast("string").alias("d")).distinct().limit(5).collect()
    if other:
        raise ValueError(f"{mart.name}: rows of other dates than {dates[0]} to {dates[-1]}: {sorted(str(r.d) for r in other)}")


def _staged(mart: Mart, df: DataFrame, root: str, version: str) -> DataFrame:
    """The mart's rows, computed and written once under root/_staging."""
    rows = df.select(*mart.columns).withColumn(version, F.current_timestamp())
    path = f"{root}/_staging/{mart.name}"
    rows.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def _publish(mart: Mart, rows: DataFrame, root: str, dates: Sequence[str]) -> dict[str, int]:
    """Replace the dates of a mart by staged rows: a dynamic overwrite of the dates that have rows, then the removal of those that have none,
    whose old rows an overwrite alone would leave. Rows by date."""
    spark = rows.sparkSession
    counts = {r.d: r.n for r in rows.groupBy(F.col(mart.date).cast("string").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row for each date
    if counts:
        dealt = rows.withColumn(mart.date, F.col(mart.date).cast("date")).hint("rebalance", F.col(mart.date))  # few files a date, but no huge ones
        dealt.sortWithinPartitions(mart.date, *mart.sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(mart.date).parquet(f"{root}/{mart.name}")
    for d in dates:
        if d not in counts:
            delete(spark, f"{root}/{mart.name}/{mart.date}={d}")
    return {d: counts.get(d, 0) for d in dates}


def load(marts: Sequence[tuple[Mart, DataFrame]], root: str, *dates: str, version: str = "loaded_at") -> dict[str, dict[str, int]]:
    """Marts of some dates; rows by mart and date. Each mart is computed once, into a staging folder, and checked there for other dates
    before the first one is touched; staged rows go at the end, also after a failure, which leaves the old rows in place."""
    spark = marts[0][1].sparkSession
    try:
        staged = [(mart, _staged(mart, df, root, version)) for mart, df in marts]
        for mart, rows in staged:
            stray_dates(mart, rows, dates)
        return {mart.name: _publish(mart, rows, root, dates) for mart, rows in staged}
    finally:
        delete(spark, f"{root}/_staging")


def read(spark: SparkSession, mart: Mart, root: str, date: str | None = None, last: str | None = None) -> DataFrame:
    """A mart; with a date, or the dates from date to last, only those partitions are scanned."""
    df = spark.read.parquet(f"{root}/{mart.name}")
    return df if date is None else df.filter(F.col(mart.date).between(F.lit(date).cast("date"), F.lit(last or date).cast("date")))


def views(spark: SparkSession, root: str, *names: str) -> list[str]:
    """Register the tables under root that exist as views of the catalog; their names."""
    there = [n for n in names if exists(spark, f"{root}/{n}")]
    for n in there:
        spark.read.parquet(f"{root}/{n}").createOrReplaceTempView(n)
    return there


def replace_days(df: DataFrame, path: str, field: str, columns: Sequence[str]) -> None:
    """Replace the UTC days that df has; other days stay. Rows are clustered by day, so a day makes few files."""
    out = df.select(*columns, F.date_format(F.col(field).cast("timestamp"), "yyyyMMdd").alias("day"))
    out.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def require(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise if a required column holds a null (file sources read every column back as nullable)."""
    bad = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    if wrong := {c: bad[c] for c in columns if bad[c]}:
        raise ValueError(f"nulls in required columns: {wrong}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sensor_marts(readings: DataFrame, excursions: DataFrame, gaps: DataFrame, root: str) -> None:
    """Readings, excursions and gaps as JSON lines with UTC times ending in Z."""
    for name, df in (("sensor_readings", readings), ("temperature_excursions", excursions), ("sensor_gaps", gaps)):
        times = {f.name: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss'Z'") for f in df.schema if f.dataType.typeName() == "timestamp"}
        write_json(df.withColumns(times) if times else df, f"{root}/{name}")


def write_batch(lines: DataFrame, truth: DataFrame, path: str) -> None:
    """Lines (raw, arrival) as text in the order of their arrival, and beside it the manifest of what was planted (JSON lines)."""
    lines.sort("arrival").select("raw").write.mode("overwrite").text(path)
    truth.sort("fault", "event_id").write.mode("overwrite").json(f"{path}.manifest")


def report_json(rows: list[dict], date: str) -> str:
    return json.dumps({"run_date": date, "passed": all(r["passed"] for r in rows), "checks": rows}, sort_keys=True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
