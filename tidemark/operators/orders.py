"""Delivery order fact and its invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import minutes_between


def order_fact(orders: DataFrame, cancellations: DataFrame, dispatches: DataFrame, deliveries: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each created order. Every side is reduced to one row an order first, with map-side combination, so the four left
    joins share the partitioning by order_id and cannot fan out; children without a created order drop out.

    orders: order_id, event_time, region_id, experiment_variant; cancellations: order_id, event_time, cancel_reason;
    dispatches: order_id, event_time, dispatch_id, rider_id, result, eta_minutes; deliveries: order_id, event_time;
    rejected: order_id, event_id, event_type (contract violations that name an order).
    """
    ts = F.col("event_time")
    accepted = F.col("result") == "accepted"
    o = orders.groupBy("order_id").agg(F.min(ts).alias("ordered_at"), F.min_by("region_id", ts).alias("region_id"), F.min_by("experiment_variant", ts).alias("experiment_variant"))
    c = cancellations.groupBy("order_id").agg(F.min(ts).alias("cancelled_at"), F.min_by("cancel_reason", ts).alias("cancel_reason"))
    latest = F.when(accepted, ts)  # accepted_at is the first acceptance, but rider, dispatch and eta are the last one's
    d = dispatches.groupBy("order_id").agg(
        F.count("*").alias("dispatch_attempts"), F.count_if(F.col("result") == "rejected").alias("dispatch_rejections"), F.min(ts).alias("first_dispatch_at"), F.min(latest).alias("accepted_at"),
        F.max_by("dispatch_id", latest).alias("accepted_dispatch_id"), F.max_by("rider_id", latest).alias("accepted_rider_id"), F.max_by("eta_minutes", latest).alias("eta_minutes"),
    )
    v = deliveries.groupBy("order_id").agg(F.min(ts).alias("delivered_at"))
    r = rejected.filter(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.count_distinct("event_id").alias("rejected_event_count"), F.count_distinct(F.when(F.col("event_type") == "DispatchResult", F.col("event_id"))).alias("rejected_dispatch_count")
    )
    wide = o
    for side in (d, v, c, r):
        wide = wide.join(side, "order_id", "left")
    status = F.when(F.col("delivered_at").isNotNull(), "delivered").when(F.col("cancelled_at").isNotNull(), "cancelled").otherwise("incomplete")
    actual = minutes_between("accepted_at", "delivered_at")  # null without an acceptance
    blank = ["accepted_dispatch_id", "accepted_rider_id", "cancel_reason"]
    zero = ["dispatch_attempts", "dispatch_rejections", "rejected_event_count", "rejected_dispatch_count"]
    return wide.withColumns(
        {
            **{k: F.coalesce(k, F.lit(0)) for k in zero},
            **{k: F.nullif(k, F.lit("")) for k in blank},
            "order_date": F.to_date("ordered_at"),
            "is_dispatch_accepted": F.col("accepted_at").isNotNull(),
            "order_status": status,
            "minutes_to_first_dispatch": minutes_between("ordered_at", "first_dispatch_at"),
            "actual_delivery_minutes": actual,
            "eta_error_minutes": actual - F.col("eta_minutes"),
        }
    )


def orphans(children: dict[str, DataFrame], parents: DataFrame, key: str = "order_id") -> DataFrame:
    """(source, key) of children whose parent is missing."""
    known = parents.select(key).distinct()
    out = None
    for name, df in children.items():
        one = df.select(F.lit(name).alias("source"), key)
        out = one if out is None else out.unionByName(one)
    return out.join(known, key, "left_anti")


def before_order(fact: DataFrame) -> DataFrame:
    """Orders with a dispatch or a delivery that precedes the order itself; comparisons with a missing time don't count."""
    def late(c: str) -> Column:
        return F.col(c) < F.col("ordered_at")

    return fact.filter(late("first_dispatch_at") | late("delivered_at"))


def delivered_without_acceptance(fact: DataFrame) -> DataFrame:
    return fact.filter((F.col("order_status") == "delivered") & ~F.col("is_dispatch_accepted"))
