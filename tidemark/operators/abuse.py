"""Session abuse scores from four signals against the population of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import clamp01, ratio, robust_z

# Fixed values of the rule.
WEIGHTS = {"speed": 0.35, "regularity": 0.25, "monotony": 0.20, "disinterest": 0.20}
THRESHOLD = 0.5
MIN_QUERIES = 5
SPEED_Z = 3.0
CV_LIMIT = 0.6
DISTINCT_LIMIT = 0.5
CLICK_LIMIT = 0.35
MAD_TO_SD = 1.4826
SWEEP = (0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75)


def population_stats(sessions: DataFrame, by: str | None = None) -> DataFrame:
    """center and scale of queries per minute: median and scaled median deviation, the population standard deviation where that is 0;
    (0, 0) for fewer than two sessions. Exact medians; one row, or one for each value of ``by``."""
    keys = [by] if by else []
    rates = sessions.filter((F.col("queries") >= MIN_QUERIES) & F.col("queries_per_minute").isNotNull()).select(*keys, F.col("queries_per_minute").alias("r"))
    base = rates.groupBy(*keys).agg(F.median("r").alias("m"), F.stddev_pop("r").alias("sd"), F.count("*").alias("n"))
    both = rates.join(F.broadcast(base), by) if by else rates.crossJoin(F.broadcast(base))  # one row, or one for each date
    spread = both.groupBy(*keys).agg(F.first("m").alias("m"), F.first("sd").alias("sd"), F.first("n").alias("n"), (F.median(F.abs(F.col("r") - F.col("m"))) * MAD_TO_SD).alias("mad"))
    enough = F.col("n") >= 2
    return spread.select(
        *keys,
        F.when(enough, F.col("m")).otherwise(0.0).alias("center"),
        F.when(enough, F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("sd"))).otherwise(0.0).alias("scale"),
    )


def _signals() -> dict[str, Column]:
    rate, avg, sd = F.col("queries_per_minute"), F.col("avg_gap_seconds"), F.col("stddev_gap_seconds")
    zero = F.lit(0.0)
    return {
        "speed": F.when(rate.isNull(), zero).otherwise(clamp01(robust_z(rate, F.col("center"), F.col("scale")) / SPEED_Z)),
        "regularity": F.when(avg.isNull() | (avg == 0) | sd.isNull(), zero).otherwise(clamp01(1 - ratio(sd, avg) / CV_LIMIT)),
        "monotony": clamp01(1 - F.col("distinct_query_ratio") / DISTINCT_LIMIT),
        "disinterest": clamp01(1 - F.col("click_rate") / CLICK_LIMIT),
    }


def score_sessions(sessions: DataFrame, threshold: float = THRESHOLD, by: str | None = None) -> DataFrame:
    """sessions with the four signals, score, is_abusive and reasons. Under MIN_QUERIES there is no signal but the reason too_few_queries."""
    stats = population_stats(sessions, by)
    # at most one row for each date; the statistics are aggregates, so their size doesn't follow the sessions
    wide = sessions.join(F.broadcast(stats), by, "left") if by else sessions.join(F.broadcast(stats), F.lit(True), "left")
    wide = wide.fillna(0.0, ["center", "scale"])
    gate = F.col("queries") >= MIN_QUERIES
    wide = wide.withColumns({k: F.when(gate, v).otherwise(0.0) for k, v in _signals().items()})
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    score = F.when(gate, F.bround(total, 4)).otherwise(0.0)
    says = {
        "speed": F.format_string("speed=%.1f/min", "queries_per_minute"),
        "regularity": F.format_string("regularity=%.2f", ratio("stddev_gap_seconds", "avg_gap_seconds")),
        "monotony": F.format_string("monotony=%.2f", "distinct_query_ratio"),
        "disinterest": F.format_string("disinterest=%.2f", "click_rate"),
    }
    reasons = F.when(gate, F.array_compact(F.array(*(F.when(F.col(k) > 0.5, text) for k, text in says.items())))).otherwise(F.array(F.lit("too_few_queries")))
    return wide.withColumns({"score": score, "reasons": reasons}).withColumn("is_abusive", F.col("score") >= threshold).withColumn("threshold", F.lit(threshold)).drop("center", "scale")


def reason_counts(scores: DataFrame) -> DataFrame:
    """How often each reason was given for a flagged session."""
    flat = scores.filter("is_abusive").select(F.explode("reasons").alias("text"))
    return flat.groupBy(F.split_part("text", F.lit("="), F.lit(1)).alias("reason")).agg(F.count("*").alias("sessions"))


def quality_of(found: Column, truth: Column) -> dict[str, Column]:
    """Confusion counts and precision, recall, F1; 1, 1 and 0 where the denominator is empty."""
    tp, fp, fn = F.count_if(found & truth), F.count_if(found & ~truth), F.count_if(~found & truth)
    p = F.coalesce(ratio(tp, tp + fp), F.lit(1.0))
    r = F.coalesce(ratio(tp, tp + fn), F.lit(1.0))
    return {"tp": tp, "fp": fp, "fn": fn, "precision": p, "recall": r, "f1": F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))}


def evaluate(scores: DataFrame, truth: DataFrame, key: str = "session_id") -> DataFrame:
    """One row of quality figures; truth holds the keys of abusive sessions. Only sessions that were scored count."""
    marked = scores.join(truth.select(key).distinct().withColumn("__true", F.lit(True)), key, "left")
    q = quality_of(F.col("is_abusive"), F.coalesce("__true", F.lit(False)))
    return marked.agg(*(c.alias(k) for k, c in q.items()))


def sweep(scores: DataFrame, truth: DataFrame, thresholds=SWEEP, key: str = "session_id") -> DataFrame:
    """evaluate() for each threshold in one pass: each session is repeated once per threshold after the join."""
    marked = scores.select(key, "score").join(truth.select(key).distinct().withColumn("__true", F.lit(True)), key, "left")
    each = marked.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    q = quality_of(F.col("score") >= F.col("threshold"), F.coalesce("__true", F.lit(False)))
    return each.groupBy("threshold").agg(*(c.alias(k) for k, c in q.items()))


def recall_by(scores: DataFrame, profiles: DataFrame, threshold: float = THRESHOLD, key: str = "session_id") -> DataFrame:
    """profile, judged, caught, recall (0 where none was judged): of the sessions of each profile, those scored and those over the threshold."""
    both = profiles.join(scores.select(key, "score"), key, "left")
    caught, judged = F.count_if(F.col("score") >= threshold), F.count("score")
    return both.groupBy("profile").agg(judged.alias("judged"), caught.alias("caught")).withColumn("recall", F.coalesce(ratio("caught", "judged"), F.lit(0.0)))
