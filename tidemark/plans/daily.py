"""A day's batch: aggregate, load, score, gate; repeatable for any date, with retries and alerts."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import abuse, dedup, quality, search
from tidemark.sinks import marts


class GateError(RuntimeError):
    """A day's marts failed a gate; the report has been written."""


def with_retries(stage: Callable[[], object], retries: int = 2, wait: float = 1.0, alert: Callable[[str], None] | None = None, name: str = "stage"):
    """Run a stage; on failure wait twice as long each time; after the last one alert and raise. An alert's own error is swallowed."""
    for k in range(retries + 1):
        try:
            return stage()
        except Exception as e:
            if k < retries:
                time.sleep(wait * 2**k)
                continue
            if alert:
                try:
                    alert(json.dumps({"stage": name, "error": str(e)[:500]}))
                except Exception:  # noqa: BLE001
                    pass
            raise


def run_day(events: DataFrame, root: str, day: str, alert: Callable[[str], None] | None = None, wait: float = 1.0, reach: int | None = None) -> dict[str, int]:
    """Marts, scores and gates of a day from all search events; rows by mart. Late events are in: the day is computed anew from everything
    that landed. Running it again replaces the day's rows by the same. Raises GateError after the report is written if a gate fails."""
    return run_range(events, root, day, day, alert, wait, reach)[day]


def run_range(events: DataFrame, root: str, first: str, last: str, alert: Callable[[str], None] | None = None, wait: float = 1.0, reach: int | None = None) -> dict[str, dict[str, int]]:
    """run_day for each date from first to last, in one pass over the events; rows by date and mart.

    Only events of sessions seen in the range are deduplicated, and only once: they are written to a work folder that all marts read.
    reach: days that a session lasts at most, which bounds the dates that are scanned; None scans those sessions' whole history.
    """
    for d in (first, last):
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", d):
            raise ValueError(f"not a date: {d!r}")
    spark = events.sparkSession
    a = date.fromisoformat(first)
    days = [str(a + timedelta(k)) for k in range((date.fromisoformat(last) - a).days + 1)]
    work = f"{root}/_work"
    near = search.sessions_seen_on(events, first, last, reach)
    dedup.earliest(near, "event_id", "event_ts", [c for c in ("session_id",) if c in events.columns]).write.mode("overwrite").parquet(work)
    clean = spark.read.schema(near.schema).parquet(work)
    inside = clean.filter(F.col("event_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    own = [(marts.SEARCH_SESSION, search.session_metrics(search.sessions_started_on(clean, first, last))), (marts.SEARCH_DAILY, search.daily_metrics(inside)), (marts.TOP_QUERY, search.top_queries(inside))]
    counts = with_retries(lambda: marts.load(own, root, *days), wait=wait, alert=alert, name="load_marts")
    marts.delete(spark, work)

    def rows_of(mart: marts.Mart, kind: str) -> DataFrame:
        return marts.read(spark, mart, root, first, last) if any(counts[mart.name].values()) else spark.createDataFrame([], kind)

    def detect() -> dict[str, dict[str, int]]:
        if not any(counts[marts.SEARCH_SESSION.name].values()):
            for d in days:
                marts.delete(spark, f"{root}/{marts.SESSION_ABUSE.name}/event_date={d}")
            return {marts.SESSION_ABUSE.name: dict.fromkeys(days, 0)}
        scores = abuse.score_sessions(marts.read(spark, marts.SEARCH_SESSION, root, first, last), by="event_date")
        return marts.load([(marts.SESSION_ABUSE, scores.withColumn("is_abusive", F.col("is_abusive").cast("int")))], root, *days, version="scored_at")

    counts |= with_retries(detect, wait=wait, alert=alert, name="detect_abuse")
    parts = [(marts.SEARCH_SESSION, "session_id string, event_date date"), (marts.SEARCH_DAILY, "event_date date"), (marts.TOP_QUERY, "rank int, event_date date"), (marts.SESSION_ABUSE, "session_id string, is_abusive int, event_date date")]
    dates = spark.createDataFrame([(date.fromisoformat(d),) for d in days], "event_date date")
    judged = quality.gates(quality.facts_by_date(dates, *(rows_of(m, k) for m, k in parts)), "event_date").collect()  # six rows a date
    by_day: dict[str, list[dict]] = {d: [] for d in days}
    for r in judged:
        by_day[str(r.event_date)].append({k: v for k, v in r.asDict().items() if k != "event_date"})
    reports = {d: marts.report_json(rows, d) for d, rows in by_day.items()}
    for d, report in reports.items():
        marts.write_text(spark, f"{root}/reports/{d}.json", report)
    kinds = "check_name string, passed boolean, observed double, expected string, run_date string"
    marts.load([(marts.QUALITY_REPORT, spark.createDataFrame([(*r.values(), d) for d, rows in by_day.items() for r in rows], kinds))], root, *days, version="checked_at")
    failed = [r for r in reports.values() if not json.loads(r)["passed"]]
    if failed:
        if alert:
            for r in failed:
                alert(r)
        raise GateError("\n".join(failed))
    return {d: {name: by[d] for name, by in counts.items()} for d in days}


def json_alerts(path: str) -> Callable[[str], None]:
    """Append alerts to a local file of JSON lines."""

    def alert(text: str) -> None:
        with open(path, "a") as f:
            f.write(text + "\n")

    return alert


