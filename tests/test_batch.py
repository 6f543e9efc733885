"""Marts, daily runs, streaming ingest and readers."""

import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts, routing
from tidemark.plans import daily, delivery
from tidemark.sinks import kafka, marts
from tidemark.sources import readers, synth
from tidemark.streaming import ingest

DAY = "2026-01-05"


@pytest.fixture(scope="module")
def log(spark):
    lines, _, _ = synth.search_log(spark, 150, mix=synth.SearchMix(bots=0.03))
    rows = routing.table_rows(contracts.check(lines.drop("event_id")), "raw_search_events")
    return rows.withColumnRenamed("event_time", "event_ts").withColumn("event_date", F.to_date("event_ts")).cache()


def snapshot(spark, root):
    return {m.name: sorted(map(str, marts.read(spark, m, root).select(*m.columns).collect())) for m in (marts.SEARCH_SESSION, marts.SEARCH_DAILY, marts.TOP_QUERY, marts.SESSION_ABUSE)}


def test_run_day_twice_gives_the_same_rows(spark, log, tmp_path):
    root = str(tmp_path)
    first = daily.run_day(log, root, DAY)
    seen = snapshot(spark, root)
    assert first["mart_search_session"] > 100 and daily.run_day(log.unionByName(log.limit(50)), root, DAY) == first
    assert snapshot(spark, root) == seen
    assert json.loads(Path(root, "reports", f"{DAY}.json").read_text())["passed"]


def test_empty_day_removes_old_rows_and_fails_the_gate(spark, log, tmp_path):
    root, said = str(tmp_path), []
    daily.run_day(log, root, DAY)
    with pytest.raises(daily.GateError):
        daily.run_day(log.filter("false"), root, DAY, alert=said.append)
    assert said and not any(Path(root, m, f"event_date={DAY}").exists() for m in ("mart_search_session", "mart_session_abuse", "mart_search_daily"))


def test_other_dates_are_refused_before_anything_is_written(spark, tmp_path):
    df = spark.sql("SELECT DATE'2026-01-06' AS event_date, 1L AS sessions, 1L AS queries, 1L AS clicks, 1L AS distinct_queries, 1.0D AS ctr")
    with pytest.raises(ValueError):
        marts.load([(marts.SEARCH_DAILY, df)], str(tmp_path), DAY)
    assert not list(tmp_path.iterdir())


def test_run_range_and_bad_date(spark, log, tmp_path):
    with pytest.raises(ValueError):
        daily.run_day(log, str(tmp_path), "5 January")
    assert list(daily.run_range(log, str(tmp_path), DAY, DAY)) == [DAY]


def test_retries_and_alert():
    calls, said = [], []

    def stage():
        calls.append(1)
        raise OSError("no")

    with pytest.raises(OSError):
        daily.with_retries(stage, 2, 0.0, said.append, "s")
    assert len(calls) == 3 and json.loads(said[0])["stage"] == "s"


def test_replace_days(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2026-01-01 23:55:00'), (2, TIMESTAMP'2026-01-02 00:00:00') AS t(id, at)")
    marts.replace_days(df, path, "at", ["id", "at"])
    assert {p.name for p in Path(path).glob("day=*")} == {"day=20260101", "day=20260102"}
    marts.replace_days(df.filter("id = 2").withColumn("id", F.lit(3)), path, "at", ["id", "at"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3]


def test_required_columns(spark):
    with pytest.raises(ValueError):
        marts.require(spark.sql("SELECT CAST(null AS int) AS a"), ["a"])


def test_stream_equals_batch(spark, tmp_path):
    lines, _ = synth.delivery_log(spark, 80)
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    lines.select("raw").repartition(6).write.text(src)
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest(ingest.file_stream(spark, src, 2), root, str(tmp_path / "ck")).awaitTermination()
    checked = contracts.check(lines.drop("event_id"))
    for name in ("raw_order_events", "raw_dispatch_events", "raw_delivery_events"):
        want = routing.table_rows(checked, name).select("event_id", "raw")
        got = ingest.raw_table(spark, root, name).select("event_id", "raw")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    dlq = ingest.raw_table(spark, root, ingest.DLQ)
    assert dlq.count() == contracts.dead_letters(checked).count()


def test_batch_that_runs_again_is_written_once(spark, tmp_path):
    lines, _ = synth.delivery_log(spark, 20)
    df = lines.select("raw", F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.current_timestamp().alias("ingested_at"))
    for _ in range(2):
        ingest.write_batch(str(tmp_path))(df, 0)
    assert ingest.raw_table(spark, str(tmp_path), "raw_order_events").count() == routing.table_rows(contracts.check(lines.drop("event_id")), "raw_order_events").count()


def test_streaming_dedup(spark, tmp_path):
    src = str(tmp_path / "e")
    spark.range(200).select(F.col("id").cast("string").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("event_ts")).write.parquet(src)
    df = spark.read.parquet(src)
    df.limit(50).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = ingest.deduplicated(stream).writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deduped").count() == 200


def test_readers(spark, tmp_path):
    (tmp_path / "part-0").write_text('{"event_id":"1","event_type":"SearchQuery","session_id":"S-1","event_time":"2026-01-01T00:00:00Z"}\n\n{"event_id":"2","event_time":"bad"}\n')
    (tmp_path / "_SUCCESS").write_text("")
    df = readers.json_events(spark, str(tmp_path))
    assert df.count() == 1 and "rank" in df.columns
    assert readers.lines(spark, str(tmp_path)).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.parts(spark, str(tmp_path / "nothing"))
    (tmp_path / "m.json").write_text(json.dumps({"truth": [{"a": 1}, {"a": 2}]}))
    assert readers.manifest(spark, str(tmp_path / "m.json"), "truth").count() == 2


def test_messages_have_topic_and_key(spark):
    df = spark.createDataFrame([('{"event_type":"OrderCreated","order_id":"O-1"}',), ('{"event_type":"SearchQuery"}',), (" ",)], "value string")
    assert sorted((r.topic, r.key) for r in kafka.messages(df).collect()) == [("orders.events", "O-1"), ("search.events", None)]


def test_an_event_type_without_a_topic_is_an_error(spark):
    with pytest.raises(Exception, match="unknown event_type: Other"):
        kafka.messages(spark.createDataFrame([('{"event_type":"Other"}',)], "value string")).collect()


def test_a_range_equals_its_days(spark, log, tmp_path):
    days = ["2026-01-05", "2026-01-06"]
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    for d in days:
        try:
            daily.run_day(log, one, d, reach=1)
        except daily.GateError:
            assert d == days[1]
    try:
        got = daily.run_range(log, many, *days)
    except daily.GateError:
        got = None
    assert snapshot(spark, one) == snapshot(spark, many) and (got is None or list(got) == days)
    assert not Path(many, "_work").exists() and not Path(many, "_staging").exists()


def test_stop_after_the_running_batch_and_throughput(spark, tmp_path):
    lines, _ = synth.delivery_log(spark, 20)
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    lines.select("raw").repartition(4).write.text(src)
    query = ingest.ingest(ingest.file_stream(spark, src, 1), root, str(tmp_path / "ck"))
    stop = threading.Event()
    stop.set()
    assert ingest.run_to_end(query, stop)["seconds"] >= 0 and not query.isActive
    rest = ingest.run_to_end(ingest.ingest(ingest.file_stream(spark, src, 1), root, str(tmp_path / "ck")))
    assert rest["rows_per_second"] >= 0
    assert sum(ingest.raw_table(spark, root, t).count() for t in ("raw_order_events", "raw_dispatch_events", "raw_delivery_events")) == contracts.check(lines.drop("event_id")).filter(F.size("violations") == 0).count()


def test_coordinates_are_numbers_within_a_split(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{k}\n" for k in range(5)))
    (tmp_path / "b.txt").write_text("x\n\ny\n")
    df = spark.read.text(str(tmp_path)).select(F.col("value").alias("raw"), F.col("_metadata.file_name").alias("topic"), F.col("_metadata.file_block_start").alias("partition"))
    got = sorted((r.topic, r.raw, r.offset) for r in ingest.numbered(df).collect())
    assert got == [("a.txt", str(k), k) for k in range(5)] + [("b.txt", "", 1), ("b.txt", "x", 0), ("b.txt", "y", 2)]


def test_batch_files_and_catalog_views(spark, tmp_path):
    lines, truth = synth.delivery_log(spark, 10)
    marts.write_batch(lines, truth, str(tmp_path / "b"))
    assert spark.read.text(str(tmp_path / "b")).count() == lines.count() and spark.read.json(str(tmp_path / "b.manifest")).count() == truth.count()
    spark.range(3).write.parquet(str(tmp_path / "raw_x"))
    assert marts.views(spark, str(tmp_path), "raw_x", "raw_y") == ["raw_x"] and spark.table("raw_x").count() == 3


def test_delivery_marts(spark, tmp_path):
    lines, truth = synth.delivery_log(spark, 200)
    checked = contracts.check(lines.drop("event_id")).cache()
    tables, dead = routing.route(checked), contracts.dead_letters(checked)
    first = delivery.run_delivery(tables, dead, str(tmp_path))
    assert first == delivery.run_delivery(tables, dead, str(tmp_path)) and first["mart_delivery_order"] == 200
    mart = spark.read.parquet(str(tmp_path / "mart_delivery_order"))
    status = {r.order_status: r.n for r in mart.groupBy("order_status").agg(F.count("*").alias("n")).collect()}
    ids = {r.event_id: r.raw for r in dead.select("event_id", "raw").collect()}
    named = sum("order_id" in raw for raw in ids.values())
    assert sum(status.values()) == 200 and status["delivered"] > 100 and mart.agg(F.sum("rejected_event_count")).first()[0] == named
    assert mart.filter("order_status = 'delivered' AND is_dispatch_accepted AND actual_delivery_minutes IS NULL").count() == 0
