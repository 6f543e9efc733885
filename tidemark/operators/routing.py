"""Accepted events to the rows of their raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import event_time

COORDINATES = ("topic", "partition", "offset", "ingested_at")
#: Table: the event types it takes and its own columns with their types.
TABLES: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "raw_order_events": (("OrderCreated", "OrderCancelled"), {"order_id": "string", "region_id": "string", "experiment_variant": "string", "cancel_reason": "string"}),
    "raw_dispatch_events": (("DispatchResult",), {"order_id": "string", "dispatch_id": "string", "rider_id": "string", "result": "string", "eta_minutes": "int"}),
    "raw_delivery_events": (("DeliveryCompleted",), {"order_id": "string", "dispatch_id": "string"}),
    "raw_search_events": (("SearchQuery", "SearchResultClick"), {"session_id": "string", "query": "string", "result_count": "int", "client": "string", "rank": "int", "doc_id": "string"}),
    "raw_sensor_events": (("SensorReading",), {"shipment_id": "string", "device_id": "string", "cargo_type": "string", "leg": "string", "temperature_c": "double", "humidity_pct": "double"}),
}
#: Order of a table's rows in a file.
SORT = {name: ("session_id" if "session_id" in own else "shipment_id" if "shipment_id" in own else "order_id", "event_time", "event_id") for name, (_, own) in TABLES.items()}


def _get(field: str, kind: str):
    return F.expr(f"try_variant_get(event, '$.{field}', '{kind}')").alias(field)


def table_rows(checked: DataFrame, name: str) -> DataFrame:
    """The accepted events of a raw table: absent optional fields are null, times are UTC, the record itself stays in raw."""
    types, columns = TABLES[name]
    own = checked.filter((F.size("violations") == 0) & F.col("event_type").isin(*types))
    at = event_time(F.expr("try_variant_get(event, '$.event_time', 'string')"))
    return own.select(
        _get("event_id", "string"), "event_type", *(_get(c, k) for c, k in columns.items()), at.alias("event_time"), _get("schema_version", "smallint"),
        *(c for c in COORDINATES if c in checked.columns), F.expr("make_valid_utf8(cast(raw AS string))").alias("raw"),
    )


def route(checked: DataFrame) -> dict[str, DataFrame]:
    return {name: table_rows(checked, name) for name in TABLES}
