"""Topics and keys of events, and a thin writer for a Kafka connector where one is installed."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The topic of each event type.
TOPICS = {
    "OrderCreated": "orders.events", "OrderCancelled": "orders.events", "DispatchResult": "dispatch.events", "DeliveryCompleted": "delivery.events",
    "SearchQuery": "search.events", "SearchResultClick": "search.events", "SensorReading": "sensor.events",
}
#: What the producer side guarantees: no duplicates by retries, all replicas confirm.
GUARANTEES = {"kafka.enable.idempotence": "true", "kafka.acks": "all", "kafka.compression.type": "lz4", "kafka.linger.ms": "20"}


def messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """topic, key (order_id, else null) and value of JSON lines; blank lines are left out. An event type without a topic is an error."""
    kind, order = F.get_json_object(column, "$.event_type"), F.get_json_object(column, "$.order_id")
    topic = F.element_at(F.create_map(*(F.lit(x) for kv in TOPICS.items() for x in kv)), kind)
    unknown = F.raise_error(F.concat(F.lit("unknown event_type: "), F.coalesce(kind, F.lit("none")))).cast("string")
    return lines.filter(F.trim(column) != "").select(F.coalesce(topic, unknown).alias("topic"), F.nullif(order, F.lit("")).alias("key"), F.col(column).alias("value"))


def publish(lines: DataFrame, servers: str, rate: int | None = None, slices: int = 1) -> dict[str, int]:
    """Send JSON lines and return the number of messages by topic; a message that isn't confirmed fails the job. With a rate (messages a
    second) they go in slices, dealt by a hash of the message, each of which takes at least its share of the time."""
    out = messages(lines).persist()
    try:
        sent = {r.topic: r.n for r in out.groupBy("topic").agg(F.count("*").alias("n")).collect()}  # a row for each topic
        for k in range(slices):
            began, part = time.monotonic(), out.filter(F.pmod(F.xxhash64("value"), F.lit(slices)) == k)
            part.write.format("kafka").options(**GUARANTEES, **{"kafka.bootstrap.servers": servers}).save()
            if rate:
                time.sleep(max(0.0, part.count() / rate - (time.monotonic() - began)))
        return sent
    finally:
        out.unpersist()
