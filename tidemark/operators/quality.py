"""Data tests that return violating rows, and the six gates of a day's marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import ratio

MAX_FLAGGED = 0.20
MAX_TOP = 20


def unique(df: DataFrame, *keys: str) -> DataFrame:
    some = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return df.filter(some).groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("rows"))


def accepted_range(df: DataFrame, column: str, low=None, high=None, inclusive: bool = True, where: Column | None = None) -> DataFrame:
    c = F.col(column)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (c < low if inclusive else c <= low)
    if high is not None:
        bad = bad | (c > high if inclusive else c >= high)
    return (df if where is None else df.filter(where)).filter(bad)


def summary(tests: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(test, severity, failures) of named (severity, violating rows)."""
    rows = [df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("test"), F.lit(severity).alias("severity"), "failures") for name, (severity, df) in tests.items()]
    return reduce(DataFrame.unionByName, rows)


def _counts(sessions: DataFrame, daily: DataFrame, top: DataFrame, scores: DataFrame) -> list[tuple[DataFrame, dict[str, Column]]]:
    n, distinct = F.count("*"), F.count_distinct
    return [
        (sessions, {"session_rows": n, "sessions": distinct("session_id")}),
        (daily, {"daily_rows": n}),
        (top, {"top_rows": n, "top_ranks": distinct("rank")}),
        (scores, {"score_rows": n, "scored": distinct("session_id"), "flagged": F.count_if(F.col("is_abusive").cast("boolean"))}),
    ]


def day_facts(sessions: DataFrame, daily: DataFrame, top: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: the counts that the gates judge, an aggregate of each mart."""
    parts = [df.agg(*(c.alias(k) for k, c in own.items())) for df, own in _counts(sessions, daily, top, scores)]
    return reduce(DataFrame.crossJoin, parts)  # each side is one aggregate row


def facts_by_date(dates: DataFrame, sessions: DataFrame, daily: DataFrame, top: DataFrame, scores: DataFrame) -> DataFrame:
    """day_facts() for each event_date of dates; 0 where a mart has no row of a date."""
    out = dates
    for df, own in _counts(sessions, daily, top, scores):
        out = out.join(df.groupBy("event_date").agg(*(c.alias(k) for k, c in own.items())), "event_date", "left").fillna(0, list(own))
    return out


def gates(facts: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, then check_name, passed, observed, expected for the six checks of a day, for each row of facts."""
    c = F.col
    share = F.coalesce(ratio("flagged", "score_rows"), F.lit(0.0))
    def same(column: str, what: str, more: str = "") -> Column:
        return F.concat(F.lit("= "), c(column).cast("string"), F.lit(f" ({what}){more}"))

    checks = [
        ("sessions_present", c("session_rows") > 0, c("session_rows"), F.lit("> 0")),
        ("session_rows_unique", c("session_rows") == c("sessions"), c("session_rows"), same("sessions", "distinct session_id")),
        ("daily_row_single", c("daily_rows") == 1, c("daily_rows"), F.lit("= 1")),
        ("top_query_ranks_unique", (c("top_rows") == c("top_ranks")) & (c("top_rows") <= MAX_TOP), c("top_rows"), same("top_ranks", "distinct rank", f", <= {MAX_TOP}")),
        ("abuse_covers_sessions", (c("score_rows") == c("session_rows")) & (c("scored") == c("session_rows")), c("score_rows"), same("session_rows", "session_rows")),
        ("flagged_ratio_bounded", share <= MAX_FLAGGED, F.bround(share, 4), F.lit(f"<= {MAX_FLAGGED}")),
    ]
    rows = F.array(*(F.struct(F.lit(n).alias("check_name"), ok.alias("passed"), seen.cast("double").alias("observed"), want.alias("expected")) for n, ok, seen, want in checks))
    return facts.select(*keep, F.inline(rows))
