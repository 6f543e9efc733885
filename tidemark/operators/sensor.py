"""Cold-chain sensor rules: cleaning, temperature excursions, transmission gaps, daily summary and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import ratio, seconds
from tidemark.operators import series
from tidemark.operators.dedup import first_arrival

# Fixed values of the rule.
CADENCE = 5 * 60
LIMIT = 15 * 60
RANGES = {"pharma": (2.0, 8.0), "frozen": (-25.0, -15.0)}


def clean(checked: DataFrame, arrival=("arrival",)) -> tuple[DataFrame, DataFrame]:
    """(readings, tally). checked: parsed readings with ``violations`` and an arrival order. Invalid rows are counted by their first
    violation once per arrival; of valid ones the first arrival stays and the others count as duplicate."""
    bad = checked.filter(F.size("violations") > 0).select(F.col("violations")[0]["code"].alias("reason"))
    good = checked.filter(F.size("violations") == 0)
    readings = first_arrival(good, "event_id", arrival)
    repeated = good.groupBy("event_id").agg((F.count("*") - 1).alias("n")).filter("n > 0")
    tally = bad.groupBy("reason").agg(F.count("*").alias("rows")).unionByName(repeated.agg(F.sum("n").alias("rows")).filter("rows is not null").select(F.lit("duplicate").alias("reason"), "rows"))
    return readings.drop("violations"), tally


def out_of_range():
    t, cargo = F.col("temperature_c"), F.col("cargo_type")
    case = None
    for kind, (low, high) in RANGES.items():
        case = F.when(cargo == kind, ~t.between(low, high)) if case is None else case.when(cargo == kind, ~t.between(low, high))
    return case.otherwise(False)


def excursions(readings: DataFrame) -> DataFrame:
    """Runs out of range of at least LIMIT, counting one cadence for the last reading; leg and cargo of the first, peak the maximum."""
    at = F.struct("event_time", "event_id")
    runs = series.islands(
        readings, "shipment_id", "event_time", "event_id", out_of_range(), LIMIT,
        [
            F.min_by("cargo_type", at).alias("cargo_type"), F.min_by("leg", at).alias("leg"), F.min("event_time").alias("start"), F.max("event_time").alias("end"),
            F.count("*").alias("readings"), F.max("temperature_c").alias("peak_c"),
        ],
    )
    length = seconds("end") - seconds("start") + CADENCE
    return runs.filter(length >= LIMIT).withColumn("duration_minutes", F.floor(length / 60).cast("long")).drop("island")


def transmission_gaps(readings: DataFrame) -> DataFrame:
    return series.gaps(readings, "shipment_id", "event_time", "event_id", LIMIT, CADENCE)


def excursion_summary(found: DataFrame) -> DataFrame:
    """By day, cargo and leg: excursions, shipments, minutes, peak."""
    return found.groupBy(F.to_date("start").alias("event_date"), "cargo_type", "leg").agg(
        F.count("*").alias("excursions"), F.count_distinct("shipment_id").alias("shipments_affected"), F.sum("duration_minutes").alias("total_minutes"), F.max("peak_c").alias("peak_c")
    )


def score(found: DataFrame, gaps: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of six figures. truth: situation (excursion, spike, dropout or offline), shipment_id, start. An excursion is right if its
    start is; precision and recall are 1 where nothing was found or planted."""
    c = F.col
    a = found.select("shipment_id", "start").distinct().withColumn("__a", F.lit(1))
    b = truth.filter("situation = 'excursion'").select("shipment_id", "start").distinct().withColumn("__b", F.lit(1))
    starts = a.join(b, ["shipment_id", "start"], "full_outer").agg(F.sum(c("__a") * c("__b")).alias("hit"), F.sum("__a").alias("found"), F.sum("__b").alias("planted"))
    marks = found.select("shipment_id", F.lit("excursion found").alias("mark")).unionByName(gaps.select("shipment_id", F.lit("gap found").alias("mark"))).unionByName(truth.select("shipment_id", c("situation").alias("mark")))
    per = marks.groupBy("shipment_id").agg(*(F.max((c("mark") == m).cast("int")).alias(m.replace(" ", "_")) for m in ("excursion found", "gap found", "spike", "dropout", "offline")))
    shipments = per.agg(
        F.sum(c("spike") * c("excursion_found")).alias("spikes_flagged"), F.sum(c("gap_found") * c("dropout")).alias("gap_hit"), F.sum("dropout").alias("dropouts"),
        F.sum(c("gap_found") * (1 - c("dropout"))).alias("gap_false_alarms"), F.sum(c("gap_found") * c("offline")).alias("offline_misreported_as_gap"),
    )
    both = starts.crossJoin(shipments).fillna(0)  # one row each
    one = F.lit(1.0)
    return both.select(
        F.coalesce(ratio("hit", "found"), one).alias("excursion_precision"), F.coalesce(ratio("hit", "planted"), one).alias("excursion_recall"), "spikes_flagged",
        F.coalesce(ratio("gap_hit", "dropouts"), one).alias("gap_recall"), "gap_false_alarms", "offline_misreported_as_gap",
    )
