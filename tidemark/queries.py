"""Queries over the driver's tables in the roles of the engine's own inputs, and the same in SQL.

events is a search log: view = query, click = result click, user = session, props' k = query text. lineitem is the children of
orders: return flag N = accepted, R = rejected dispatch, line status F = delivery; an order of status P is cancelled.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.core import json_string, lag_seconds, ratio
from tidemark.operators import abuse, contracts, dedup, orders, quality, routing, search, sensor, series
from tidemark.plans import daily
from tidemark.session import scratch_dir, spread
from tidemark.sinks import kafka, marts
from tidemark.streaming import ingest

DAY, LAST_DAY = "2024-01-01", "2024-01-03"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c, n: int = 6):
    return F.round(c, n)


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def search_events(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", search.QUERY).when(F.col("event_type") == "click", search.CLICK).otherwise(F.col("event_type"))
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("session_id"), kind.alias("event_type"), F.get_json_object("props", "$.k").alias("query"),
        F.col("ts").cast("timestamp").alias("event_ts"), F.to_date("ts").alias("event_date"), F.when(F.col("event_id") % 2 == 0, "web").otherwise("app").alias("client"),
        (F.floor("value").cast("long") % 10 + 1).alias("rank"),
    )


EV = """ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, CASE event_type WHEN 'view' THEN 'SearchQuery' WHEN 'click' THEN 'SearchResultClick' ELSE event_type END AS event_type,
json_extract_string(props, '$.k') AS query, ts AS event_ts, CAST(ts AS DATE) AS event_date, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'app' END AS client,
CAST(floor(value) AS BIGINT) % 10 + 1 AS rank FROM events)"""
SEC = "CAST(floor(epoch_us({}) / 1000000.0) AS BIGINT)"
SESS = f"""{EV}, started AS (SELECT *, min(event_date) OVER (PARTITION BY session_id) AS session_date FROM ev),
g AS (SELECT *, {SEC.format("event_ts")} - lag({SEC.format("event_ts")}) OVER (PARTITION BY session_id ORDER BY event_ts, event_id) AS gap FROM started WHERE event_type = 'SearchQuery'),
q AS (SELECT session_id, min(session_date) AS event_date, count(*) AS queries, count(DISTINCT query) AS distinct_queries, min(event_ts) AS first_at, max(event_ts) AS last_at,
  avg(gap) AS avg_gap, min(gap) AS min_gap, stddev_pop(gap) AS sd_gap, arg_min(client, (event_ts, event_id)) AS client FROM g GROUP BY session_id),
c AS (SELECT session_id, count(*) AS clicks, avg(rank) AS avg_rank FROM ev WHERE event_type = 'SearchResultClick' GROUP BY session_id),
s AS (SELECT q.*, coalesce(clicks, 0) AS clicks, avg_rank, coalesce(clicks, 0)::DOUBLE / queries AS click_rate, distinct_queries::DOUBLE / queries AS dratio,
  {SEC.format("last_at")} - {SEC.format("first_at")} AS span FROM q LEFT JOIN c USING (session_id)),
f AS (SELECT *, CASE WHEN span > 0 THEN queries / (span / 60.0::DOUBLE) END AS qpm FROM s)"""
POP = f"""{SESS}, rates AS (SELECT qpm FROM f WHERE queries >= 5 AND qpm IS NOT NULL), med AS (SELECT median(qpm) AS m, stddev_pop(qpm) AS sd, count(*) AS n FROM rates),
mad AS (SELECT median(abs(qpm - (SELECT m FROM med))) * 1.4826 AS mad FROM rates),
pop AS (SELECT CASE WHEN n >= 2 THEN m ELSE 0.0 END AS center, CASE WHEN n >= 2 THEN CASE WHEN mad > 0 THEN mad ELSE sd END ELSE 0.0 END AS scale FROM med, mad)"""
SCORE = f"""{POP}, sig AS (SELECT f.*, queries >= 5 AS gate,
  CASE WHEN qpm IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, CASE WHEN scale > 0 THEN (qpm - center) / scale ELSE 0.0 END / 3.0)) END AS s1,
  CASE WHEN avg_gap IS NULL OR avg_gap = 0 OR sd_gap IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - sd_gap / avg_gap / 0.6)) END AS s2,
  greatest(0.0, least(1.0, 1 - dratio / 0.5)) AS s3, greatest(0.0, least(1.0, 1 - click_rate / 0.35)) AS s4 FROM f, pop),
sc AS (SELECT session_id, event_date, gate, CASE WHEN gate THEN s1 ELSE 0.0 END AS speed, CASE WHEN gate THEN s2 ELSE 0.0 END AS regularity, CASE WHEN gate THEN s3 ELSE 0.0 END AS monotony,
  CASE WHEN gate THEN s4 ELSE 0.0 END AS disinterest, CASE WHEN gate THEN round_even(s1 * 0.35 + s2 * 0.25 + s3 * 0.2 + s4 * 0.2, 4) ELSE 0.0 END AS score FROM sig)"""


def _sessions(spark, d):
    return search.session_metrics(search_events(spark, d))


def session_metrics(spark, d):
    return _sessions(spark, d).select(
        "session_id", "event_date", "queries", "distinct_queries", "clicks", _r("click_rate").alias("click_rate"), _r("distinct_query_ratio").alias("distinct_query_ratio"),
        _r("avg_gap_seconds").alias("avg_gap_seconds"), "min_gap_seconds", _r("stddev_gap_seconds").alias("stddev_gap_seconds"), _r("avg_click_rank").alias("avg_click_rank"), "span_seconds",
        _r("queries_per_minute").alias("queries_per_minute"), "client", _stamp("first_query_at").alias("first_query_at"), _stamp("last_query_at").alias("last_query_at"),
    )


def _scores(spark, d):
    return abuse.score_sessions(_sessions(spark, d))


def _truth(scores):
    return scores.filter(F.pmod(F.col("session_id").cast("long"), F.lit(7)) == 0).select("session_id")


def abuse_scores(spark, d):
    named = F.concat_ws(",", F.array_sort(F.transform("reasons", lambda r: F.split_part(r, F.lit("="), F.lit(1))))).alias("reasons")
    return _scores(spark, d).select("session_id", "event_date", *(_r(k).alias(k) for k in abuse.WEIGHTS), _r("score", 4).alias("score"), F.col("is_abusive").cast("int").alias("is_abusive"), "threshold", named)


def abuse_sweep(spark, d):
    scores = _scores(spark, d)
    return abuse.sweep(scores, _truth(scores)).select("threshold", "tp", "fp", "fn", *(_r(k).alias(k) for k in ("precision", "recall", "f1")))


def abuse_evaluation(spark, d):
    scores = abuse.score_sessions(_sessions(spark, d), threshold=0.3)
    return abuse.evaluate(scores, _truth(scores)).select("tp", "fp", "fn", *(_r(k).alias(k) for k in ("precision", "recall", "f1")))


_PR = """round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1.0 END, 6) AS recall,
round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1"""
_CONF = "count(*) FILTER (hit AND t) AS tp, count(*) FILTER (hit AND NOT t) AS fp, count(*) FILTER (NOT hit AND t) AS fn"
_PRF = "*, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1.0 END AS r"


# order roles -------------------------------------------------------------------------------------------------------------------


def order_parts(spark, d):
    o, li = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    created = o.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp").alias("event_time"), (F.col("o_custkey") % 5).cast("string").alias("region_id"), F.col("o_orderpriority").alias("experiment_variant"))
    cancelled = o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 1 day")).alias("event_time"), F.lit("customer_request").alias("cancel_reason"))
    # one dispatch for each distinct ship date of an order: total order, so the latest acceptance is a single row
    result = F.when(F.col("l_returnflag") == "N", "accepted").when(F.col("l_returnflag") == "R", "rejected").otherwise("other")
    rank = Window.partitionBy("l_orderkey", "l_shipdate").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice")
    sent = li.withColumn("rn", F.row_number().over(rank)).filter("rn = 1")
    dispatch = sent.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").cast("timestamp").alias("event_time"), F.col("l_partkey").cast("string").alias("dispatch_id"), F.col("l_suppkey").cast("string").alias("rider_id"),
        result.alias("result"), F.col("l_quantity").cast("int").alias("eta_minutes"),
    )
    delivered = li.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").cast("timestamp").alias("event_time"))
    kind = F.when(F.col("l_returnflag") == "R", "DispatchResult").otherwise("DeliveryCompleted")
    rejected = li.filter("l_discount > 0.08").select(F.col("l_orderkey").alias("order_id"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("event_id"), kind.alias("event_type"))
    return created, cancelled, dispatch, delivered, rejected


def _fact(spark, d):
    return orders.order_fact(*order_parts(spark, d))


def order_fact(spark, d):
    stamps = ["ordered_at", "first_dispatch_at", "accepted_at", "delivered_at", "cancelled_at"]
    minutes = ["minutes_to_first_dispatch", "actual_delivery_minutes", "eta_error_minutes"]
    f = _fact(spark, d)
    rest = [c for c in f.columns if c not in stamps + minutes]
    return f.select(*rest, *(_stamp(c).alias(c) for c in stamps), *(_r(c).alias(c) for c in minutes))


FACT = """o AS (SELECT o_orderkey AS order_id, min(o_orderdate) AS ordered_at, min(CAST(o_custkey % 5 AS VARCHAR)) AS region_id, min(o_orderpriority) AS experiment_variant FROM orders GROUP BY 1),
sent AS (SELECT l_orderkey AS order_id, l_shipdate AS t, CAST(l_partkey AS VARCHAR) AS dispatch_id, CAST(l_suppkey AS VARCHAR) AS rider_id, l_returnflag AS flag, CAST(l_quantity AS INT) AS eta,
  row_number() OVER (PARTITION BY l_orderkey, l_shipdate ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, l_extendedprice) AS rn FROM lineitem),
d AS (SELECT order_id, count(*) AS dispatch_attempts, count(*) FILTER (flag = 'R') AS dispatch_rejections, min(t) AS first_dispatch_at, min(t) FILTER (flag = 'N') AS accepted_at,
  arg_max(dispatch_id, t) FILTER (flag = 'N') AS accepted_dispatch_id, arg_max(rider_id, t) FILTER (flag = 'N') AS accepted_rider_id, arg_max(eta, t) FILTER (flag = 'N') AS eta_minutes FROM sent WHERE rn = 1 GROUP BY 1),
v AS (SELECT l_orderkey AS order_id, min(l_shipdate) AS delivered_at FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
c AS (SELECT o_orderkey AS order_id, min(o_orderdate) + INTERVAL 1 DAY AS cancelled_at FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
r AS (SELECT l_orderkey AS order_id, count(DISTINCT concat_ws('-', l_partkey, l_suppkey)) AS rejected_event_count,
  count(DISTINCT CASE WHEN l_returnflag = 'R' THEN concat_ws('-', l_partkey, l_suppkey) END) AS rejected_dispatch_count FROM lineitem WHERE l_discount > 0.08 GROUP BY 1),
fact AS (SELECT o.order_id, ordered_at, region_id, experiment_variant, coalesce(dispatch_attempts, 0) AS dispatch_attempts, coalesce(dispatch_rejections, 0) AS dispatch_rejections, first_dispatch_at, accepted_at,
  nullif(accepted_dispatch_id, '') AS accepted_dispatch_id, nullif(accepted_rider_id, '') AS accepted_rider_id, eta_minutes, delivered_at, cancelled_at, CASE WHEN cancelled_at IS NOT NULL THEN 'customer_request' END AS cancel_reason,
  coalesce(rejected_event_count, 0) AS rejected_event_count, coalesce(rejected_dispatch_count, 0) AS rejected_dispatch_count, CAST(ordered_at AS DATE) AS order_date, accepted_at IS NOT NULL AS is_dispatch_accepted,
  CASE WHEN delivered_at IS NOT NULL THEN 'delivered' WHEN cancelled_at IS NOT NULL THEN 'cancelled' ELSE 'incomplete' END AS order_status,
  (epoch(first_dispatch_at) - epoch(ordered_at)) / 60.0 AS minutes_to_first_dispatch, (epoch(delivered_at) - epoch(accepted_at)) / 60.0 AS actual_delivery_minutes,
  (epoch(delivered_at) - epoch(accepted_at)) / 60.0 - eta_minutes AS eta_error_minutes
  FROM o LEFT JOIN d USING (order_id) LEFT JOIN v USING (order_id) LEFT JOIN c USING (order_id) LEFT JOIN r USING (order_id))"""

# series roles ------------------------------------------------------------------------------------------------------------------


def _series(spark, d):
    return _table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")


def series_islands(spark, d):
    at = F.struct("ts", "event_id")
    runs = series.islands(
        _series(spark, d), "user_id", "ts", "event_id", F.col("value") > 100, 86400,
        [F.min_by("event_type", at).alias("leg"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("readings"), F.max("value").alias("peak")],
    )
    return runs.filter("readings >= 2").drop("island")


ISLANDS = f"""n AS (SELECT *, lag({SEC.format("ts")}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
b AS (SELECT *, coalesce(value > 100, false) AS hot, CASE WHEN NOT coalesce(value > 100, false) OR p IS NULL OR {SEC.format("ts")} - p > 86400 THEN 1 ELSE 0 END AS brk FROM n),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b),
runs AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS leg, min(ts) AS s, max(ts) AS e, count(*) AS readings, max(value) AS peak FROM i WHERE hot GROUP BY user_id, island HAVING count(*) >= 2)"""

# contract roles ----------------------------------------------------------------------------------------------------------------


def _raw_sql(spark_side: bool) -> str:
    """A JSON record for each row of events, with planted faults; the same expression for both engines but for the time format."""
    time = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")" if spark_side else "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
    head = f"""'{{"schema_version":' || CASE WHEN event_id % 41 = 0 THEN '2' ELSE '1' END || ',"event_id":"E' || CAST(event_id AS STRING) || '","event_time":"' || {time} || CASE WHEN event_id % 29 = 0 THEN '' ELSE 'Z' END || '"'"""
    who = "CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 43 = 0 THEN ',\"session_id\":\"ABC\"' ELSE ',\"session_id\":\"S-' || CAST(user_id AS STRING) || '\"' END"
    text = "',\"query\":\"' || CASE WHEN event_id % 17 = 0 THEN '' ELSE 'k' || CAST(user_id AS STRING) END || '\"'"
    extra = "CASE WHEN event_id % 31 = 0 THEN ',\"surplus\":1' ELSE '' END"
    query = "',\"result_count\":' || CASE WHEN event_id % 19 = 0 THEN '\"7\"' ELSE '7' END || ',\"client\":\"' || CASE WHEN event_id % 23 = 0 THEN 'tv' ELSE 'web' END || '\"'"
    click = "',\"rank\":' || CASE WHEN event_id % 11 = 0 THEN '0' ELSE '3' END || CASE WHEN event_id % 37 = 0 THEN '' ELSE ',\"doc_id\":\"d1\"' END"
    whole = f"{head} || {who} || {text} || {extra}"
    return f"""CASE event_type WHEN 'view' THEN {whole} || ',"event_type":"SearchQuery"' || {query} || '}}'
WHEN 'click' THEN {whole} || ',"event_type":"SearchResultClick"' || {click} || '}}'
WHEN 'purchase' THEN {head} || ',"event_type":"Purchase"}}' WHEN 'error' THEN {head} || '}}'
ELSE CASE WHEN event_id % 2 = 0 THEN '[1,2]' ELSE {head} END END"""


def _checked(spark, d):
    raw = _table(spark, d, "events").select("event_id", "user_id", F.expr(_raw_sql(True)).alias("raw"))
    return contracts.check(raw.withColumnRenamed("event_id", "n"))


RAW = f"""raws AS (SELECT event_id AS n, {_raw_sql(False)} AS raw FROM events),
kinds AS (SELECT *, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN json_type(raw) END AS jt FROM raws),
objs AS (SELECT *, json_extract_string(raw, '$.event_type') AS et, json_keys(raw) AS ks FROM kinds WHERE ok AND jt = 'OBJECT'),
good AS (SELECT * FROM objs WHERE et IN ('SearchQuery', 'SearchResultClick')),
viol AS (SELECT n, 'invalid_json' AS code, NULL AS field FROM kinds WHERE NOT ok UNION ALL SELECT n, 'not_an_object', NULL FROM kinds WHERE ok AND jt <> 'OBJECT'
UNION ALL SELECT n, 'missing_event_type', 'event_type' FROM objs WHERE et IS NULL
UNION ALL SELECT n, 'unknown_event_type', 'event_type' FROM objs WHERE et IS NOT NULL AND et NOT IN ('SearchQuery', 'SearchResultClick')
UNION ALL SELECT n, 'schema_violation', 'schema_version' FROM good WHERE CAST(json_extract_string(raw, '$.schema_version') AS INT) <> 1
UNION ALL SELECT n, 'schema_violation', 'session_id' FROM good WHERE NOT list_contains(ks, 'session_id') OR NOT regexp_full_match(json_extract_string(raw, '$.session_id'), 'S-[0-9a-f]+')
UNION ALL SELECT n, 'schema_violation', 'query' FROM good WHERE length(json_extract_string(raw, '$.query')) < 1
UNION ALL SELECT n, 'schema_violation', 'result_count' FROM good WHERE et = 'SearchQuery' AND json_type(raw, '$.result_count') NOT IN ('UBIGINT', 'BIGINT')
UNION ALL SELECT n, 'schema_violation', 'client' FROM good WHERE et = 'SearchQuery' AND json_extract_string(raw, '$.client') NOT IN ('web', 'app')
UNION ALL SELECT n, 'schema_violation', 'rank' FROM good WHERE et = 'SearchResultClick' AND CAST(json_extract_string(raw, '$.rank') AS INT) < 1
UNION ALL SELECT n, 'schema_violation', 'doc_id' FROM good WHERE et = 'SearchResultClick' AND NOT list_contains(ks, 'doc_id')
UNION ALL SELECT n, 'schema_violation', NULL FROM good WHERE list_contains(ks, 'surplus')
UNION ALL SELECT n, 'invalid_event_time', 'event_time' FROM good WHERE json_extract_string(raw, '$.event_time') NOT LIKE '%Z')"""


def dlq_rows(spark, d):
    return contracts.dead_letters(_checked(spark, d), "n").select("n", "event_id", "event_type", "reason_code", "field", F.md5("raw").alias("raw_md5"))


# marts and gates ---------------------------------------------------------------------------------------------------------------


def _day_marts(spark, d):
    e = search_events(spark, d)
    first = F.lit(DAY).cast("date")
    own = search.sessions_started_on(e, first)
    sessions = search.session_metrics(own)
    return sessions, search.daily_metrics(search.day_events(e, first)), search.top_queries(search.day_events(e, first)), abuse.score_sessions(sessions)


def quality_gates(spark, d):
    return quality.gates(quality.day_facts(*_day_marts(spark, d))).select("check_name", F.col("passed").cast("int").alias("passed"), "observed", "expected")


def data_tests(spark, d):
    o, li, e = (_table(spark, d, t) for t in ("orders", "lineitem", "events"))
    return quality.summary(
        {
            "order_key_unique": ("error", quality.unique(o, "o_orderkey")),
            "line_unique": ("warn", quality.unique(li, "l_orderkey", "l_linenumber")),
            "event_value_not_null": ("error", quality.not_null(e, "value")),
            "status_accepted": ("error", quality.accepted_values(o, "o_orderstatus", ["F", "O"])),
            "quantity_range": ("warn", quality.accepted_range(li, "l_quantity", 1, 45)),
            "discount_range_exclusive": ("warn", quality.accepted_range(li, "l_discount", 0, 0.1, inclusive=False, where=F.col("l_returnflag") == "R")),
        }
    )


def singular_tests(spark, d):
    f = _fact(spark, d)
    lone = orders.orphans({"orders": _table(spark, d, "customer").select(F.col("c_custkey").alias("order_id"))}, _table(spark, d, "orders").select(F.col("o_custkey").alias("order_id")))
    return quality.summary({"delivered_without_acceptance": ("warn", orders.delivered_without_acceptance(f)), "step_before_order": ("error", orders.before_order(f)), "orphans": ("warn", lone)})


def orphan_children(spark, d):
    o, li = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    kids = {"lineitem": li.select(F.col("l_partkey").alias("order_id")), "orders": o.select(F.col("o_custkey").alias("order_id"))}
    lone = orders.orphans(kids, _table(spark, d, "supplier").select(F.col("s_suppkey").alias("order_id")))
    return lone.groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("order_id").alias("keys"))


LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _lines(spark, d):
    return _table(spark, d, "lineitem").withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))


def dedup_first_arrival(spark, d):
    return dedup.first_arrival(_lines(spark, d), "line_id", LINE_ORDER).select("line_id", "l_partkey", "l_suppkey", "l_quantity")


def dedup_latest_version(spark, d):
    return dedup.latest_version(_lines(spark, d), ["l_orderkey", "l_linenumber"], "l_shipdate", LINE_ORDER[1:]).select("line_id", "l_partkey", "l_suppkey", "l_quantity")


def ingest_lag(spark, d):
    o, li = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    j = li.join(o, li.l_orderkey == o.o_orderkey).select("o_orderpriority", lag_seconds("o_orderdate", "l_shipdate").alias("lag"))
    return j.groupBy("o_orderpriority").agg(F.min("lag").alias("min_lag"), F.max("lag").alias("max_lag"), F.count_if(F.col("lag") < 0).alias("early"), F.count("*").alias("rows"))


_ROUTED = ("event_id", "event_type", "session_id", "query", "result_count", "client", "rank", "doc_id")


def routed_rows(spark, d):
    """The accepted search events as rows of their raw table."""
    rows = routing.table_rows(_checked(spark, d), "raw_search_events")
    return rows.select(*_ROUTED, _stamp("event_time").alias("event_time"))


def stream_ingest(spark, d):
    """The contract records as files through the streaming ingest: what lands in the search table and in the dead letters."""
    root = scratch_dir(spark, "ingest")
    spread(_table(spark, d, "events").select(F.expr(_raw_sql(True)).alias("value"))).write.text(f"{root}/in")
    ingest.run_to_end(ingest.ingest(ingest.file_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint"))
    dead = ingest.raw_table(spark, f"{root}/out", ingest.DLQ).select("event_id", "event_type", "reason_code", "field", F.md5("raw").alias("raw_md5"))
    rows = ingest.raw_table(spark, f"{root}/out", "raw_search_events")
    return dead.unionByName(rows.select("event_id", "event_type", F.lit(None).cast("string").alias("reason_code"), F.lit(None).cast("string").alias("field"), F.md5("raw").alias("raw_md5")))


def stream_dedup(spark, d):
    """Events sent twice through the streaming dedup; what comes out by type."""
    root = scratch_dir(spark, "dedup")
    e = _table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("event_ts"))
    e.unionAll(e).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{root}/in")
    out = ingest.deduplicated(stream, delay="60 days").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


def day_run_twice(spark, d):
    """A day's batch run two times; the sessions and their scores afterwards."""
    root = scratch_dir(spark, "marts")
    events = search_events(spark, d)
    for _ in range(2):
        daily.run_day(events, root, DAY)
    scores = marts.read(spark, marts.SESSION_ABUSE, root, DAY).select("session_id", _r("score", 4).alias("score"), "is_abusive")
    return marts.read(spark, marts.SEARCH_SESSION, root, DAY).select("session_id", "event_date", "queries", "distinct_queries", "clicks", "span_seconds").join(scores, "session_id")


def day_run_range(spark, d):
    """Three days in one pass; the daily and top-query marts afterwards."""
    root = scratch_dir(spark, "range")
    with contextlib.suppress(daily.GateError):  # a date on which no session began fails its gate; its marts are written
        daily.run_range(search_events(spark, d), root, DAY, LAST_DAY)
    top = marts.read(spark, marts.TOP_QUERY, root).select("event_date", "rank", "query", "queries", "sessions", "clicks")
    return top.unionByName(marts.read(spark, marts.SEARCH_DAILY, root).select("event_date", F.lit(0).alias("rank"), F.lit("").alias("query"), "queries", "sessions", "clicks"))


# other contracts ---------------------------------------------------------------------------------------------------------------


def _other_raw_sql(spark_side: bool) -> str:
    """A record of the order, dispatch, delivery or sensor contracts for each row of events, with planted faults."""
    time = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")" if spark_side else "strftime(ts, '%Y-%m-%dT%H:%M:%S')"

    def head(kind: str) -> str:
        return f"""'{{"schema_version":1,"event_id":"E' || CAST(event_id AS STRING) || '","event_type":"{kind}","event_time":"' || {time} || 'Z"'"""

    def cases(*pairs: tuple[int, str], other: str) -> str:
        return "CASE " + " ".join(f"WHEN event_id % {m} = 0 THEN {t}" for m, t in pairs) + f" ELSE {other} END"

    order = cases((7, "''"), (11, "',\"order_id\":\"ABC\"'"), other="',\"order_id\":\"O-' || CAST(user_id AS STRING) || '\"'")
    made = cases((13, "''"), other="',\"region_id\":\"R1\"'") + " || ',\"experiment_variant\":\"' || " + cases((17, "'treatmnt'"), other="'control'") + " || '\"'"
    gone = cases((19, "''"), (23, "',\"cancel_reason\":\"bored\"'"), other="',\"cancel_reason\":\"no_rider\"'")
    result = cases((3, "',\"result\":\"rejected\"'"), (29, "',\"result\":\"maybe\"'"), (31, "''"), other="',\"result\":\"accepted\"'")
    eta = cases((37, "''"), (41, "',\"eta_minutes\":0'"), (43, "',\"eta_minutes\":\"35\"'"), other="',\"eta_minutes\":35'")
    done = cases((47, "''"), other="',\"dispatch_id\":\"x1\"'") + " || " + cases((53, "',\"note\":\"a\"'"), other="''")
    where = cases((59, "',\"shipment_id\":\"S1\"'"), other="',\"shipment_id\":\"SH-' || CAST(user_id AS STRING) || '\"'") + " || ',\"device_id\":\"D-a1\",\"cargo_type\":\"' || " + cases((61, "'fish'"), other="'frozen'")
    heat = "'\",\"leg\":\"inland\",\"temperature_c\":' || " + cases((67, "'-999'"), (71, "'\"-18\"'"), other="'-18.5'") + " || " + cases((73, "',\"humidity_pct\":101'"), other="''")
    return f"""CASE event_id % 5 WHEN 0 THEN {head("OrderCreated")} || {order} || {made} WHEN 1 THEN {head("OrderCancelled")} || {order} || {gone}
WHEN 2 THEN {head("DispatchResult")} || {order} || ',"dispatch_id":"x1","rider_id":"r1"' || {result} || {eta} WHEN 3 THEN {head("DeliveryCompleted")} || {order} || {done}
ELSE {head("SensorReading")} || {where} || {heat} END || '}}'"""


def _other_checked(spark, d):
    return contracts.check(_table(spark, d, "events").select(F.col("event_id").alias("n"), F.expr(_other_raw_sql(True)).alias("raw")))


OTHER = f"""raws AS (SELECT event_id AS n, {_other_raw_sql(False)} AS raw FROM events),
p AS (SELECT *, json_keys(raw) AS ks, raw->>'$.event_type' AS et, raw->>'$.result' AS result, raw->>'$.eta_minutes' AS eta, json_type(raw, '$.eta_minutes') AS eta_kind, raw->>'$.temperature_c' AS t, json_type(raw, '$.temperature_c') AS t_kind FROM raws),
viol AS (SELECT n, et, 'order_id' AS field FROM p WHERE et <> 'SensorReading' AND (NOT list_contains(ks, 'order_id') OR NOT regexp_full_match(raw->>'$.order_id', 'O-[0-9]+'))
UNION ALL SELECT n, et, 'region_id' FROM p WHERE et = 'OrderCreated' AND NOT list_contains(ks, 'region_id')
UNION ALL SELECT n, et, 'experiment_variant' FROM p WHERE et = 'OrderCreated' AND (raw->>'$.experiment_variant') NOT IN ('control', 'treatment')
UNION ALL SELECT n, et, 'cancel_reason' FROM p WHERE et = 'OrderCancelled' AND (NOT list_contains(ks, 'cancel_reason') OR (raw->>'$.cancel_reason') NOT IN ('customer_request', 'no_rider', 'store_closed'))
UNION ALL SELECT n, et, 'result' FROM p WHERE et = 'DispatchResult' AND (NOT list_contains(ks, 'result') OR result NOT IN ('accepted', 'rejected'))
UNION ALL SELECT n, et, 'eta_minutes' FROM p WHERE et = 'DispatchResult' AND ((NOT list_contains(ks, 'eta_minutes') AND coalesce(result = 'accepted', true)) OR eta_kind = 'VARCHAR' OR TRY_CAST(eta AS INT) < 1)
UNION ALL SELECT n, et, 'dispatch_id' FROM p WHERE et = 'DeliveryCompleted' AND NOT list_contains(ks, 'dispatch_id')
UNION ALL SELECT n, et, NULL FROM p WHERE et = 'DeliveryCompleted' AND list_contains(ks, 'note')
UNION ALL SELECT n, et, 'shipment_id' FROM p WHERE et = 'SensorReading' AND NOT regexp_full_match(raw->>'$.shipment_id', 'SH-[0-9]+')
UNION ALL SELECT n, et, 'cargo_type' FROM p WHERE et = 'SensorReading' AND (raw->>'$.cargo_type') NOT IN ('pharma', 'frozen')
UNION ALL SELECT n, et, 'temperature_c' FROM p WHERE et = 'SensorReading' AND (t_kind = 'VARCHAR' OR TRY_CAST(t AS DOUBLE) NOT BETWEEN -80 AND 80)
UNION ALL SELECT n, et, 'humidity_pct' FROM p WHERE list_contains(ks, 'humidity_pct') AND TRY_CAST(raw->>'$.humidity_pct' AS DOUBLE) > 100)"""


def first_violation_tally(spark, d):
    return contracts.tally(_other_checked(spark, d))


def validator_scoring(spark, d):
    """The validator's verdicts on search records against the planted session faults and versions."""
    checked = _checked(spark, d)
    flagged = checked.filter(F.size("violations") > 0).select("n")
    planted = _table(spark, d, "events").filter("event_type IN ('view', 'click') AND (event_id % 13 = 0 OR event_id % 41 = 0 OR event_id % 5 = 0)").select(F.col("event_id").alias("n"))
    return contracts.score(flagged, planted, "n").withColumns({k: _r(k) for k in ("precision", "recall")})


def recall_by_profile(spark, d):
    scores = _scores(spark, d)
    kind = F.when(F.pmod(F.col("session_id").cast("long"), F.lit(3)) == 0, "aggressive").otherwise("stealth")
    known = scores.select("session_id", kind.alias("profile")).unionByName(spark.createDataFrame([("none", "unseen")], "session_id string, profile string"))
    return abuse.recall_by(scores, known, 0.3).withColumn("recall", _r("recall"))


def publish_messages(spark, d):
    lines = _table(spark, d, "events").select(F.expr(_other_raw_sql(True)).alias("value"))
    return kafka.messages(lines).groupBy("topic").agg(F.count("*").alias("messages"), F.count("key").alias("keyed"), F.count_distinct("key").alias("keys"))


# sensor roles ------------------------------------------------------------------------------------------------------------------


def _sensor_sql(spark_side: bool) -> str:
    """Readings of events: each user is a shipment with a reading every five minutes; runs out of range, spikes, holes, faults."""
    step = "make_interval(0, 0, 0, 0, 0, CAST(5 * rn + 30 * holes AS INT))" if spark_side else "to_minutes(CAST(5 * rn + 30 * holes AS INT))"
    return f"""WITH seen AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, sum(CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS holes FROM events),
made AS (SELECT 'E' || CAST(event_id AS STRING) AS event_id, 'SH-' || CAST(user_id AS STRING) AS shipment_id, user_id, event_id AS n, CASE WHEN user_id % 2 = 0 THEN 'pharma' ELSE 'frozen' END AS cargo_type,
  CASE event_type WHEN 'view' THEN 'warehouse' WHEN 'click' THEN 'inland' ELSE 'international' END AS leg, TIMESTAMP '2024-01-01 00:00:00' + {step} AS event_time,
  CASE WHEN user_id % 2 = 0 THEN 5.0 ELSE -20.0 END + (event_id % 100) / 100.0 + CASE WHEN CAST(floor(rn / 6) AS INT) % 4 = 0 OR event_id % 29 = 0 THEN 9.0 ELSE 0.0 END AS temperature_c,
  CASE WHEN event_id % 23 = 0 THEN 'schema_violation' WHEN event_id % 37 = 0 THEN 'invalid_event_time' END AS reason FROM seen),
readings AS (SELECT *, CAST(n AS DOUBLE) AS arrival FROM made UNION ALL SELECT event_id, shipment_id, user_id, n, cargo_type, leg, event_time, temperature_c + 20, reason, n + 1e9 FROM made WHERE n % 10 = 0)"""


def _readings(spark, d):
    """Parsed readings with violations, in order of arrival."""
    spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).createOrReplaceTempView("__sensor_events")
    sql = _sensor_sql(True).replace("FROM events)", "FROM __sensor_events)")
    code = F.when(F.col("reason").isNotNull(), F.array(F.struct(F.col("reason").alias("code")))).otherwise(F.array().cast("array<struct<code:string>>"))
    return spark.sql(f"{sql} SELECT event_id, shipment_id, user_id, cargo_type, leg, event_time, CAST(temperature_c AS DOUBLE) AS temperature_c, reason, arrival FROM readings").withColumn("violations", code)


def _cleaned(spark, d):
    return sensor.clean(_readings(spark, d))[0]


def sensor_excursions(spark, d):
    return sensor.excursions(_cleaned(spark, d)).select("shipment_id", "cargo_type", "leg", _stamp("start").alias("start"), _stamp("end").alias("end"), "duration_minutes", "readings", _r("peak_c", 4).alias("peak_c"))


def sensor_gaps(spark, d):
    return sensor.transmission_gaps(_cleaned(spark, d)).select("shipment_id", _stamp("after").alias("after"), _stamp("before").alias("before"), "missing_minutes")


def sensor_scoring(spark, d):
    """Excursions and gaps against a truth that lacks a third of them, with starts that are an hour off and situations of other shipments."""
    clean = _cleaned(spark, d)
    found = sensor.excursions(clean)
    number = F.split_part("shipment_id", F.lit("-"), F.lit(2)).cast("long")
    planted = found.filter(number % 3 != 0).select(F.lit("excursion").alias("situation"), "shipment_id", "start")
    wrong = found.filter(number % 5 == 0).select(F.lit("excursion").alias("situation"), "shipment_id", (F.col("start") + F.expr("interval 1 hour")).alias("start"))
    ships = clean.select("shipment_id").distinct().withColumn("situation", F.explode(F.array_compact(F.array(F.when(number % 2 == 0, "dropout"), F.when(number % 7 == 0, "offline"), F.when(number % 11 == 0, "spike")))))
    truth = planted.unionByName(wrong).unionByName(ships.select("situation", "shipment_id", F.lit(None).cast("timestamp").alias("start")))
    return sensor.score(found, sensor.transmission_gaps(clean), truth).withColumns({k: _r(k) for k in ("excursion_precision", "excursion_recall", "gap_recall")})


SENSOR = f"""{_sensor_sql(False)},
good AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) AS k FROM readings WHERE reason IS NULL) WHERE k = 1),
steps AS (SELECT *, epoch(event_time) AS sec, lag(epoch(event_time)) OVER w AS before_sec, lag(event_time) OVER w AS before_ts FROM good WINDOW w AS (PARTITION BY shipment_id ORDER BY event_time, event_id)),
marked AS (SELECT *, CASE cargo_type WHEN 'pharma' THEN temperature_c NOT BETWEEN 2 AND 8 ELSE temperature_c NOT BETWEEN -25 AND -15 END AS hot FROM steps),
cut AS (SELECT *, sum(CASE WHEN NOT hot OR before_sec IS NULL OR sec - before_sec > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY shipment_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT shipment_id, arg_min(cargo_type, (event_time, event_id)) AS cargo_type, arg_min(leg, (event_time, event_id)) AS leg, min(event_time) AS s, max(event_time) AS e, count(*) AS readings, max(temperature_c) AS peak_c,
  max(sec) - min(sec) + 300 AS length FROM cut WHERE hot GROUP BY shipment_id, run),
excursions AS (SELECT *, CAST(floor(length / 60) AS BIGINT) AS duration_minutes FROM runs WHERE length >= 900),
gaps AS (SELECT shipment_id, before_ts, event_time, CAST(floor((sec - before_sec - 300) / 60) AS BIGINT) AS missing_minutes FROM steps WHERE sec - before_sec > 900)"""


def _order_by(cols):
    return ", ".join(cols)


QUERIES = {
    "session_metrics": session_metrics,
    "day_events": lambda s, d: search.day_events(search_events(s, d), DAY).select("event_id", "session_id", "event_type", "event_date"),
    "session_started_on_date": lambda s, d: search.sessions_started_on(search_events(s, d), DAY).select("event_id", "session_id", "event_date"),
    "daily_metrics": lambda s, d: search.daily_metrics(search_events(s, d)).withColumn("ctr", _r("ctr")),
    "query_popularity": lambda s, d: search.query_popularity(search_events(s, d)).withColumn("ctr", _r("ctr")),
    "top_queries_per_day": lambda s, d: search.top_queries(search_events(s, d)).withColumn("ctr", _r("ctr")),
    "clicks_after_query": lambda s, d: search.clicks_after_query(search_events(s, d)).select("event_id", "session_id", "query"),
    "dedup_first_arrival": dedup_first_arrival,
    "dedup_latest_version": dedup_latest_version,
    "dedup_savings": lambda s, d: dedup.savings(_lines(s, d), ["l_orderkey", "l_linenumber"]),
    "order_fact": order_fact,
    "order_status_counts": lambda s, d: _fact(s, d).groupBy("order_status", "is_dispatch_accepted").agg(F.count("*").alias("orders")),
    "eta_error_by_variant": lambda s, d: _fact(s, d).groupBy("experiment_variant").agg(
        F.count("eta_error_minutes").alias("measured"), _r(F.avg("eta_error_minutes"), 4).alias("avg_eta_error"), _r(F.avg("actual_delivery_minutes"), 4).alias("avg_delivery"), _r(ratio(F.count_if("is_dispatch_accepted"), F.count("*"))).alias("acceptance")
    ),
    "argmin_argmax": lambda s, d: _table(s, d, "lineitem").groupBy("l_suppkey").agg(
        F.min_by("l_partkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")).alias("first_part"), F.max_by("l_partkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")).alias("last_part")
    ),
    "guarded_conditional_min": lambda s, d: _table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("min_returned"), F.count_if(F.col("l_returnflag") == "R").alias("returned")),
    "exact_distinct_if": lambda s, d: _table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_suppkey"))).alias("large_suppliers")),
    "orphan_children": orphan_children,
    "orders_without_children": lambda s, d: _table(s, d, "orders").join(_table(s, d, "lineitem").select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey"),
    "events_before_order": lambda s, d: orders.before_order(_fact(s, d)).select("order_id", "order_status"),
    "delivered_without_accept": lambda s, d: orders.delivered_without_acceptance(_fact(s, d)).select("order_id"),
    "population_stats": lambda s, d: abuse.population_stats(_sessions(s, d)).select(_r("center").alias("center"), _r("scale").alias("scale")),
    "population_stats_by_date": lambda s, d: abuse.population_stats(_sessions(s, d), "event_date").select("event_date", _r("center").alias("center"), _r("scale").alias("scale")),
    "abuse_scores": abuse_scores,
    "abuse_reasons_count": lambda s, d: abuse.reason_counts(abuse.score_sessions(_sessions(s, d), threshold=0.2)),
    "abuse_threshold_sweep": abuse_sweep,
    "abuse_evaluation": abuse_evaluation,
    "series_gaps": lambda s, d: series.gaps(_series(s, d), "user_id", "ts", "event_id", 86400, 300).select("user_id", _stamp("after").alias("after"), _stamp("before").alias("before"), "missing_minutes"),
    "series_islands": lambda s, d: series_islands(s, d).select("user_id", "leg", _stamp("start").alias("start"), _stamp("end").alias("end"), "readings", _r("peak").alias("peak")),
    "excursion_daily_summary": lambda s, d: series_islands(s, d).groupBy(F.to_date("start").alias("event_date"), "leg").agg(F.count("*").alias("excursions"), F.count_distinct("user_id").alias("shipments"), F.sum("readings").alias("total_readings"), _r(F.max("peak")).alias("max_peak")),
    "contract_violations": lambda s, d: contracts.dead_letters(_checked(s, d), "n").select("n", F.col("reason_code").alias("code"), "field"),
    "dlq_rows": dlq_rows,
    "reject_tally": lambda s, d: contracts.dead_letters(_checked(s, d), "n").groupBy(F.col("reason_code").alias("code")).agg(F.count("*").alias("violations"), F.count_distinct("n").alias("records")),
    "ingest_counters": lambda s, d: contracts.counters(_checked(s, d)).select("consumed", "accepted", "rejected"),
    "dlq_order_id_extract": lambda s, d: _table(s, d, "events").select("event_id", json_string(F.concat(F.lit('{"order_id":'), F.when(F.col("event_id") % 3 == 0, F.lit('""')).when(F.col("event_id") % 3 == 1, F.concat(F.lit('"O-'), F.col("user_id"), F.lit('"'))).otherwise(F.lit("17")), F.lit("}")), "order_id").alias("order_id")),
    "quality_gates": quality_gates,
    "data_tests": data_tests,
    "singular_tests": singular_tests,
    "ingest_lag": ingest_lag,
    "truth_set_operations": lambda s, d: _set_operations(s, d),
    "stream_ingest": stream_ingest,
    "stream_dedup": stream_dedup,
    "day_run_twice": day_run_twice,
    "day_run_range": day_run_range,
    "routed_rows": routed_rows,
    "other_contract_violations": lambda s, d: contracts.dead_letters(_other_checked(s, d), "n").select("n", "event_type", F.col("reason_code").alias("code"), "field"),
    "first_violation_tally": first_violation_tally,
    "validator_scoring": validator_scoring,
    "recall_by_profile": recall_by_profile,
    "publish_messages": publish_messages,
    "sensor_clean_tally": lambda s, d: sensor.clean(_readings(s, d))[1],
    "sensor_readings": lambda s, d: _cleaned(s, d).select("event_id", "shipment_id", "cargo_type", "leg", _stamp("event_time").alias("event_time"), _r("temperature_c", 4).alias("temperature_c")),
    "sensor_excursions": sensor_excursions,
    "sensor_gaps": sensor_gaps,
    "sensor_daily_summary": lambda s, d: sensor.excursion_summary(sensor.excursions(_cleaned(s, d))).withColumn("peak_c", _r("peak_c", 4)),
    "sensor_scoring": sensor_scoring,
}


def _set_operations(spark, d):
    a = _table(spark, d, "events").filter("event_type = 'purchase'").select("user_id")
    b = _table(spark, d, "events").filter("event_type = 'error' AND value > 50").select("user_id")
    parts = {"both": a.intersect(b), "only_a": a.exceptAll(b).distinct().join(b.distinct(), "user_id", "left_anti"), "either": a.union(b).distinct(), "all": a.unionAll(b)}
    return quality.summary({k: ("set", v) for k, v in parts.items()}).select(F.col("test").alias("operation"), F.col("failures").alias("rows"))


def _first_line(order: str) -> str:
    return f"SELECT line_id, l_partkey, l_suppkey, l_quantity FROM (SELECT *, l_orderkey || '-' || l_linenumber AS line_id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS rn FROM lineitem) WHERE rn = 1"


_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
_POPULAR = f"""{EV}, q AS (SELECT event_date, query, count(*) AS queries, count(DISTINCT session_id) AS sessions FROM ev WHERE event_type = 'SearchQuery' GROUP BY 1, 2),
c AS (SELECT event_date, query, count(*) AS clicks FROM ev WHERE event_type = 'SearchResultClick' GROUP BY 1, 2),
p AS (SELECT q.*, coalesce(clicks, 0) AS clicks, round(coalesce(clicks, 0)::DOUBLE / queries, 6) AS ctr FROM q LEFT JOIN c ON q.event_date = c.event_date AND q.query = c.query)"""
_D = f"DATE '{DAY}'"

ORACLE_SQL = {
    "session_metrics": f"""WITH {SESS} SELECT session_id, event_date, queries, distinct_queries, clicks, round(click_rate, 6) AS click_rate, round(dratio, 6) AS distinct_query_ratio, round(avg_gap, 6) AS avg_gap_seconds,
min_gap AS min_gap_seconds, round(sd_gap, 6) AS stddev_gap_seconds, round(avg_rank, 6) AS avg_click_rank, span AS span_seconds, round(qpm, 6) AS queries_per_minute, client,
{_STAMP.format("first_at")} AS first_query_at, {_STAMP.format("last_at")} AS last_query_at FROM f""",
    "day_events": f"WITH {EV} SELECT event_id, session_id, event_type, event_date FROM ev WHERE event_date = {_D}",
    "session_started_on_date": f"WITH {EV} SELECT event_id, session_id, event_date FROM (SELECT *, min(event_date) OVER (PARTITION BY session_id) AS sd FROM ev) WHERE sd = {_D}",
    "daily_metrics": f"""WITH {EV}, a AS (SELECT event_date, count(DISTINCT session_id) AS sessions, count(*) FILTER (event_type = 'SearchQuery') AS queries, count(*) FILTER (event_type = 'SearchResultClick') AS clicks,
count(DISTINCT CASE WHEN event_type = 'SearchQuery' THEN query END) AS distinct_queries FROM ev GROUP BY 1) SELECT *, round(CASE WHEN queries > 0 THEN clicks::DOUBLE / queries END, 6) AS ctr FROM a""",
    "query_popularity": f"WITH {_POPULAR} SELECT * FROM p",
    "top_queries_per_day": f"WITH {_POPULAR} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_date ORDER BY queries DESC, query)::INT AS rank FROM p) WHERE rank <= 20",
    "clicks_after_query": f"WITH {EV} SELECT event_id, session_id, query FROM ev c WHERE event_type = 'SearchResultClick' AND EXISTS (SELECT 1 FROM ev q WHERE q.event_type = 'SearchQuery' AND q.session_id = c.session_id AND q.query = c.query AND q.event_ts <= c.event_ts)",
    "dedup_first_arrival": _first_line(_order_by(LINE_ORDER)),
    "dedup_latest_version": _first_line(_order_by(f"{c} DESC" for c in LINE_ORDER)),
    "dedup_savings": "SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS kept, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS dropped FROM lineitem",
    "order_fact": f"""WITH {FACT} SELECT order_id, region_id, experiment_variant, dispatch_attempts, dispatch_rejections, accepted_dispatch_id, accepted_rider_id, eta_minutes, cancel_reason, rejected_event_count, rejected_dispatch_count, order_date,
is_dispatch_accepted, order_status, {", ".join(f"{_STAMP.format(c)} AS {c}" for c in ("ordered_at", "first_dispatch_at", "accepted_at", "delivered_at", "cancelled_at"))},
{", ".join(f"round({c}, 6) AS {c}" for c in ("minutes_to_first_dispatch", "actual_delivery_minutes", "eta_error_minutes"))} FROM fact""",
    "order_status_counts": f"WITH {FACT} SELECT order_status, is_dispatch_accepted, count(*) AS orders FROM fact GROUP BY 1, 2",
    "eta_error_by_variant": f"WITH {FACT} SELECT experiment_variant, count(eta_error_minutes) AS measured, round(avg(eta_error_minutes), 4) AS avg_eta_error, round(avg(actual_delivery_minutes), 4) AS avg_delivery, round(count(*) FILTER (is_dispatch_accepted)::DOUBLE / count(*), 6) AS acceptance FROM fact GROUP BY 1",
    "argmin_argmax": "SELECT l_suppkey, arg_min(l_partkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS first_part, arg_max(l_partkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS last_part FROM lineitem GROUP BY 1",
    "guarded_conditional_min": "SELECT l_orderkey, min(l_quantity) FILTER (l_returnflag = 'R') AS min_returned, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1",
    "exact_distinct_if": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_suppkey END) AS large_suppliers FROM lineitem GROUP BY 1",
    "orphan_children": "SELECT source, count(*) AS rows, count(DISTINCT k) AS keys FROM (SELECT 'lineitem' AS source, l_partkey AS k FROM lineitem UNION ALL SELECT 'orders', o_custkey FROM orders) WHERE k NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1",
    "orders_without_children": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "events_before_order": f"WITH {FACT} SELECT order_id, order_status FROM fact WHERE first_dispatch_at < ordered_at OR delivered_at < ordered_at",
    "delivered_without_accept": f"WITH {FACT} SELECT order_id FROM fact WHERE order_status = 'delivered' AND NOT is_dispatch_accepted",
    "population_stats": f"WITH {POP} SELECT round(center, 6) AS center, round(scale, 6) AS scale FROM pop",
    "population_stats_by_date": f"""WITH {SESS}, rates AS (SELECT event_date, qpm FROM f WHERE queries >= 5 AND qpm IS NOT NULL), med AS (SELECT event_date, median(qpm) AS m, stddev_pop(qpm) AS sd, count(*) AS n FROM rates GROUP BY 1),
mad AS (SELECT event_date, any_value(m) AS m, any_value(sd) AS sd, any_value(n) AS n, median(abs(qpm - m)) * 1.4826 AS mad FROM rates JOIN med USING (event_date) GROUP BY 1)
SELECT event_date, round(CASE WHEN n >= 2 THEN m ELSE 0.0 END, 6) AS center, round(CASE WHEN n >= 2 THEN CASE WHEN mad > 0 THEN mad ELSE sd END ELSE 0.0 END, 6) AS scale FROM mad""",
    "abuse_scores": f"""WITH {SCORE} SELECT session_id, event_date, round(speed, 6) AS speed, round(regularity, 6) AS regularity, round(monotony, 6) AS monotony, round(disinterest, 6) AS disinterest, score, CAST(score >= 0.5 AS INT) AS is_abusive, 0.5::DOUBLE AS threshold,
CASE WHEN gate THEN concat_ws(',', CASE WHEN disinterest > 0.5 THEN 'disinterest' END, CASE WHEN monotony > 0.5 THEN 'monotony' END, CASE WHEN regularity > 0.5 THEN 'regularity' END, CASE WHEN speed > 0.5 THEN 'speed' END) ELSE 'too_few_queries' END AS reasons FROM sc""",
    "abuse_reasons_count": f"""WITH {SCORE}, r AS (SELECT unnest(list_filter([CASE WHEN speed > 0.5 THEN 'speed' END, CASE WHEN regularity > 0.5 THEN 'regularity' END, CASE WHEN monotony > 0.5 THEN 'monotony' END, CASE WHEN disinterest > 0.5 THEN 'disinterest' END], lambda x: x IS NOT NULL)) AS reason FROM sc WHERE gate AND score >= 0.2)
SELECT reason, count(*) AS sessions FROM r GROUP BY 1""",
    "abuse_threshold_sweep": f"""WITH {SCORE}, th AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in abuse.SWEEP)}]) AS threshold), m AS (SELECT threshold, score >= threshold AS hit, CAST(session_id AS BIGINT) % 7 = 0 AS t FROM sc, th),
cf AS (SELECT threshold, {_CONF} FROM m GROUP BY 1), h AS (SELECT {_PRF} FROM cf) SELECT threshold, tp, fp, fn, {_PR} FROM h""",
    "abuse_evaluation": f"WITH {SCORE}, m AS (SELECT score >= 0.3 AS hit, CAST(session_id AS BIGINT) % 7 = 0 AS t FROM sc), cf AS (SELECT {_CONF} FROM m), h AS (SELECT {_PRF} FROM cf) SELECT tp, fp, fn, {_PR} FROM h",
    "series_gaps": f"""SELECT user_id, {_STAMP.format("p")} AS after, {_STAMP.format("ts")} AS before, CAST(floor(({SEC.format("ts")} - {SEC.format("p")} - 300) / 60.0) AS BIGINT) AS missing_minutes
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE {SEC.format("ts")} - {SEC.format("p")} > 86400""",
    "series_islands": f"WITH {ISLANDS} SELECT user_id, leg, {_STAMP.format('s')} AS start, {_STAMP.format('e')} AS \"end\", readings, round(peak, 6) AS peak FROM runs",
    "excursion_daily_summary": f"WITH {ISLANDS} SELECT CAST(s AS DATE) AS event_date, leg, count(*) AS excursions, count(DISTINCT user_id) AS shipments, CAST(sum(readings) AS BIGINT) AS total_readings, round(max(peak), 6) AS max_peak FROM runs GROUP BY 1, 2",
    "contract_violations": f"WITH {RAW} SELECT n, code, field FROM viol",
    "dlq_rows": f"""WITH {RAW} SELECT v.n, CASE WHEN ok AND jt = 'OBJECT' THEN json_extract_string(raw, '$.event_id') END AS event_id, CASE WHEN ok AND jt = 'OBJECT' THEN json_extract_string(raw, '$.event_type') END AS event_type,
code AS reason_code, field, md5(raw) AS raw_md5 FROM viol v JOIN kinds k ON v.n = k.n""",
    "reject_tally": f"WITH {RAW} SELECT code, count(*) AS violations, count(DISTINCT n) AS records FROM viol GROUP BY 1",
    "ingest_counters": f"WITH {RAW} SELECT (SELECT count(*) FROM raws) AS consumed, (SELECT count(*) FROM raws) - count(DISTINCT n) AS accepted, count(DISTINCT n) AS rejected FROM viol",
    "dlq_order_id_extract": "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'O-' || user_id END AS order_id FROM events",
    "quality_gates": f"""WITH {SCORE.replace("FROM started WHERE", f"FROM started WHERE session_date = {_D} AND").replace("FROM ev WHERE event_type = 'SearchResultClick' GROUP BY session_id", f"FROM started WHERE session_date = {_D} AND event_type = 'SearchResultClick' GROUP BY session_id")},
de AS (SELECT * FROM ev WHERE event_date = {_D}), dq AS (SELECT query, count(*) AS n FROM de WHERE event_type = 'SearchQuery' GROUP BY 1),
top AS (SELECT rank FROM (SELECT row_number() OVER (ORDER BY n DESC, query) AS rank FROM dq) WHERE rank <= 20),
m AS (SELECT (SELECT count(*) FROM f) AS session_rows, (SELECT count(DISTINCT session_id) FROM f) AS session_keys, (SELECT count(DISTINCT event_date) FROM de) AS daily_rows, (SELECT count(*) FROM top) AS top_rows,
  (SELECT count(DISTINCT rank) FROM top) AS top_ranks, (SELECT count(*) FROM sc) AS abuse_rows, (SELECT count(DISTINCT session_id) FROM sc) AS abuse_keys, (SELECT count(*) FILTER (score >= 0.5) FROM sc) AS flagged),
n AS (SELECT *, CASE WHEN abuse_rows > 0 THEN flagged::DOUBLE / abuse_rows ELSE 0.0 END AS share FROM m)
SELECT 'sessions_present' AS check_name, CAST(session_rows > 0 AS INT) AS passed, session_rows::DOUBLE AS observed, '> 0' AS expected FROM n
UNION ALL SELECT 'session_rows_unique', CAST(session_rows = session_keys AS INT), session_rows, '= ' || session_keys || ' (distinct session_id)' FROM n
UNION ALL SELECT 'daily_row_single', CAST(daily_rows = 1 AS INT), daily_rows, '= 1' FROM n
UNION ALL SELECT 'top_query_ranks_unique', CAST(top_rows = top_ranks AND top_rows <= 20 AS INT), top_rows, '= ' || top_ranks || ' (distinct rank), <= 20' FROM n
UNION ALL SELECT 'abuse_covers_sessions', CAST(abuse_rows = session_rows AND session_rows = abuse_keys AS INT), abuse_rows, '= ' || session_rows || ' (session_rows)' FROM n
UNION ALL SELECT 'flagged_ratio_bounded', CAST(share <= 0.2 AS INT), round_even(share, 4)::DOUBLE, '<= 0.2' FROM n""",
    "data_tests": """SELECT 'order_key_unique' AS test, 'error' AS severity, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS failures
UNION ALL SELECT 'line_unique', 'warn', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'event_value_not_null', 'error', (SELECT count(*) FROM events WHERE value IS NULL)
UNION ALL SELECT 'status_accepted', 'error', (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
UNION ALL SELECT 'quantity_range', 'warn', (SELECT count(*) FROM lineitem WHERE l_quantity < 1 OR l_quantity > 45)
UNION ALL SELECT 'discount_range_exclusive', 'warn', (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND (l_discount <= 0 OR l_discount >= 0.1))""",
    "singular_tests": f"""WITH {FACT} SELECT 'delivered_without_acceptance' AS test, 'warn' AS severity, (SELECT count(*) FROM fact WHERE order_status = 'delivered' AND NOT is_dispatch_accepted) AS failures
UNION ALL SELECT 'step_before_order', 'error', (SELECT count(*) FROM fact WHERE first_dispatch_at < ordered_at OR delivered_at < ordered_at)
UNION ALL SELECT 'orphans', 'warn', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))""",
    "ingest_lag": "SELECT o_orderpriority, min(g) AS min_lag, max(g) AS max_lag, count(*) FILTER (g < 0) AS early, count(*) AS rows FROM (SELECT o_orderpriority, (epoch_ms(l_shipdate) - epoch_ms(o_orderdate)) / 1000.0 AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1",
    "truth_set_operations": """WITH a AS (SELECT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50)
SELECT 'both' AS operation, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS rows UNION ALL SELECT 'only_a', (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b))
UNION ALL SELECT 'either', (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) UNION ALL SELECT 'all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)""",
    "stream_ingest": f"""WITH {RAW}, dead AS (SELECT CASE WHEN ok AND jt = 'OBJECT' THEN json_extract_string(raw, '$.event_id') END AS event_id, CASE WHEN ok AND jt = 'OBJECT' THEN json_extract_string(raw, '$.event_type') END AS event_type,
code AS reason_code, field, md5(raw) AS raw_md5 FROM viol v JOIN kinds k ON v.n = k.n) SELECT * FROM dead
UNION ALL SELECT json_extract_string(raw, '$.event_id'), et, NULL, NULL, md5(raw) FROM good WHERE n NOT IN (SELECT n FROM viol)""",
    "routed_rows": f"""WITH {RAW} SELECT raw->>'$.event_id' AS event_id, et AS event_type, raw->>'$.session_id' AS session_id, raw->>'$.query' AS query, CAST(raw->>'$.result_count' AS INT) AS result_count, raw->>'$.client' AS client,
CAST(raw->>'$.rank' AS INT) AS rank, raw->>'$.doc_id' AS doc_id, strftime(strptime(raw->>'$.event_time', '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%d %H:%M:%S.%f') AS event_time FROM good WHERE n NOT IN (SELECT n FROM viol)""",
    "other_contract_violations": f"WITH {OTHER} SELECT n, et AS event_type, 'schema_violation' AS code, field FROM viol",
    "first_violation_tally": f"WITH {OTHER} SELECT 'schema_violation' AS reason, count(DISTINCT n) AS rows FROM viol",
    "validator_scoring": f"""WITH {RAW}, f AS (SELECT DISTINCT n FROM viol), t AS (SELECT DISTINCT event_id AS n FROM events WHERE event_type IN ('view', 'click') AND (event_id % 13 = 0 OR event_id % 41 = 0 OR event_id % 5 = 0)),
c AS (SELECT (SELECT count(*) FROM f WHERE n IN (SELECT n FROM t)) AS tp, (SELECT count(*) FROM f WHERE n NOT IN (SELECT n FROM t)) AS fp, (SELECT count(*) FROM t WHERE n NOT IN (SELECT n FROM f)) AS fn)
SELECT *, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall FROM c""",
    "recall_by_profile": f"""WITH {SCORE}, k AS (SELECT CASE WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN 'aggressive' ELSE 'stealth' END AS profile, score FROM sc)
SELECT profile, count(*) AS judged, count(*) FILTER (score >= 0.3) AS caught, round(count(*) FILTER (score >= 0.3)::DOUBLE / count(*), 6) AS recall FROM k GROUP BY 1 UNION ALL SELECT 'unseen', 0, 0, 0.0""",
    "publish_messages": f"""WITH {OTHER}, m AS (SELECT CASE et WHEN 'DispatchResult' THEN 'dispatch.events' WHEN 'DeliveryCompleted' THEN 'delivery.events' WHEN 'SensorReading' THEN 'sensor.events' ELSE 'orders.events' END AS topic, raw->>'$.order_id' AS key FROM p)
SELECT topic, count(*) AS messages, count(key) AS keyed, count(DISTINCT key) AS keys FROM m GROUP BY 1""",
    "sensor_clean_tally": f"{SENSOR} SELECT reason, count(*) AS rows FROM readings WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT event_id) FROM readings WHERE reason IS NULL",
    "sensor_readings": f"{SENSOR} SELECT event_id, shipment_id, cargo_type, leg, {_STAMP.format('event_time')} AS event_time, round(temperature_c::DOUBLE, 4) AS temperature_c FROM good",
    "sensor_excursions": f"{SENSOR} SELECT shipment_id, cargo_type, leg, {_STAMP.format('s')} AS start, {_STAMP.format('e')} AS \"end\", duration_minutes, readings, round(peak_c::DOUBLE, 4) AS peak_c FROM excursions",
    "sensor_gaps": f"{SENSOR} SELECT shipment_id, {_STAMP.format('before_ts')} AS after, {_STAMP.format('event_time')} AS before, missing_minutes FROM gaps",
    "sensor_daily_summary": f"{SENSOR} SELECT CAST(s AS DATE) AS event_date, cargo_type, leg, count(*) AS excursions, count(DISTINCT shipment_id) AS shipments_affected, CAST(sum(duration_minutes) AS BIGINT) AS total_minutes, round(max(peak_c)::DOUBLE, 4) AS peak_c FROM excursions GROUP BY 1, 2, 3",
    "sensor_scoring": f"""{SENSOR}, num AS (SELECT *, CAST(split_part(shipment_id, '-', 2) AS BIGINT) AS u FROM excursions), planted AS (SELECT shipment_id, s FROM num WHERE u % 3 <> 0 UNION SELECT shipment_id, s + INTERVAL 1 HOUR FROM num WHERE u % 5 = 0),
found AS (SELECT DISTINCT shipment_id, s FROM excursions), hit AS (SELECT count(*) AS n FROM found JOIN planted USING (shipment_id, s)), ships AS (SELECT DISTINCT shipment_id, user_id AS u FROM good),
g AS (SELECT DISTINCT shipment_id FROM gaps)
SELECT round(n::DOUBLE / (SELECT count(*) FROM found), 6) AS excursion_precision, round(n::DOUBLE / (SELECT count(*) FROM planted), 6) AS excursion_recall,
(SELECT count(DISTINCT shipment_id) FROM ships WHERE u % 11 = 0 AND shipment_id IN (SELECT shipment_id FROM found)) AS spikes_flagged,
round((SELECT count(*) FROM ships WHERE u % 2 = 0 AND shipment_id IN (FROM g))::DOUBLE / (SELECT count(*) FROM ships WHERE u % 2 = 0), 6) AS gap_recall,
(SELECT count(*) FROM ships WHERE u % 2 <> 0 AND shipment_id IN (FROM g)) AS gap_false_alarms, (SELECT count(*) FROM ships WHERE u % 7 = 0 AND shipment_id IN (FROM g)) AS offline_misreported_as_gap FROM hit""",
    "stream_dedup": "SELECT event_type, count(DISTINCT event_id) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
    "day_run_twice": f"""WITH {SCORE.replace("FROM started WHERE", f"FROM started WHERE session_date = {_D} AND").replace("FROM ev WHERE event_type = 'SearchResultClick' GROUP BY session_id", f"FROM started WHERE session_date = {_D} AND event_type = 'SearchResultClick' GROUP BY session_id")}
SELECT session_id, f.event_date, queries, distinct_queries, clicks, span AS span_seconds, score, CAST(score >= 0.5 AS INT) AS is_abusive FROM f JOIN sc USING (session_id)""",
    "day_run_range": f"""WITH {_POPULAR}, r AS (SELECT *, row_number() OVER (PARTITION BY event_date ORDER BY queries DESC, query) AS rank FROM p WHERE event_date BETWEEN {_D} AND DATE '{LAST_DAY}')
SELECT event_date, rank::INT AS rank, query, queries, sessions, clicks FROM r WHERE rank <= 20
UNION ALL SELECT event_date, 0, '', count(*) FILTER (event_type = 'SearchQuery'), count(DISTINCT session_id), count(*) FILTER (event_type = 'SearchResultClick') FROM ev WHERE event_date BETWEEN {_D} AND DATE '{LAST_DAY}' GROUP BY 1""",
}
