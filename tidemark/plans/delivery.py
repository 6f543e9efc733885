"""The delivery marts: the order fact from the raw tables and the dead letters, with its tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import json_string
from tidemark.operators import dedup, orders
from tidemark.plans.daily import GateError
from tidemark.sinks import marts

DELIVERY_ORDER = marts.Mart("mart_delivery_order", (
    "order_id", "ordered_at", "order_date", "region_id", "experiment_variant", "dispatch_attempts", "dispatch_rejections", "first_dispatch_at", "accepted_at", "accepted_dispatch_id", "accepted_rider_id",
    "eta_minutes", "delivered_at", "cancelled_at", "cancel_reason", "rejected_event_count", "rejected_dispatch_count", "is_dispatch_accepted", "order_status", "minutes_to_first_dispatch",
    "actual_delivery_minutes", "eta_error_minutes",
), "order_date", ("order_id",))


def fact_from_raw(tables: dict[str, DataFrame], dead: DataFrame) -> DataFrame:
    """The order fact of the raw tables by name (first arrivals by their ``order`` columns, else by event time) and the dead letters."""

    def first(name: str) -> DataFrame:
        df = tables[name]
        return dedup.first_arrival(df, "event_id", [c for c in dedup.ARRIVAL if c in df.columns] or ["event_time"])

    made = first("raw_order_events")
    rejected = dead.select(json_string("raw", "order_id").alias("order_id"), "event_id", "event_type")
    return orders.order_fact(made.filter("event_type = 'OrderCreated'"), made.filter("event_type = 'OrderCancelled'"), first("raw_dispatch_events"), first("raw_delivery_events"), rejected)


def run_delivery(tables: dict[str, DataFrame], dead: DataFrame, root: str) -> dict[str, int]:
    """Write the order mart anew, by order date, and return its rows and the rows that fail its tests. A step before its order is an error,
    raised after the mart is written; a delivery without an acceptance is a warning."""
    fact = fact_from_raw(tables, dead)
    out = fact.select(*DELIVERY_ORDER.columns).withColumn("loaded_at", F.current_timestamp())
    path = f"{root}/{DELIVERY_ORDER.name}"
    out.hint("rebalance", F.col("order_date")).sortWithinPartitions("order_date", *DELIVERY_ORDER.sort).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("order_date").parquet(path)
    mart = fact.sparkSession.read.parquet(path)
    early, lone = orders.before_order(mart), orders.delivered_without_acceptance(mart)
    counts = {DELIVERY_ORDER.name: mart.count(), "step_before_order": early.count(), "delivered_without_acceptance": lone.count()}
    if counts["step_before_order"]:
        raise GateError(str(counts))
    return counts
