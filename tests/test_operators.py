"""Golden cases, boundaries and ground-truth floors of the analytics operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import core
from tidemark.operators import abuse, contracts, dedup, orders, quality, search, sensor
from tidemark.sources import synth

T0 = datetime(2026, 1, 1)


def events(spark, rows):
    """rows: (event_id, kind, session, query, second)"""
    data = [(e, search.QUERY if k == "q" else search.CLICK, s, q, "web", 1, T0 + timedelta(seconds=t)) for e, k, s, q, t in rows]
    df = spark.createDataFrame(data, "event_id string, event_type string, session_id string, query string, client string, rank int, event_ts timestamp")
    return df.withColumn("event_date", F.to_date("event_ts"))


def test_event_time_grammar(spark):
    cases = {"2026-01-01T00:00:00Z": True, "2026-01-01 00:00:00+09:00": True, "2026-01-01T00:00:00+0900": True, "2026-01-01T00:00Z": True, "2026-01-01T00:00:00": False, "2026": False, "T00:00:00Z": False, "2026-13-45T25:61:00Z": False, "2026-01-01T00:00:00Z\n": False}
    df = spark.createDataFrame(list(cases), "string").select("value", core.event_time("value").alias("t"))
    assert {r.value: r.t is not None for r in df.collect()} == cases


def test_clamp_keeps_null(spark):
    row = spark.sql("SELECT CAST(null AS DOUBLE) AS a, 1.5D AS b, -1.0D AS c").select(*(core.clamp01(F.col(c)).alias(c) for c in "abc")).first()
    assert tuple(row) == (None, 1.0, 0.0)


def test_first_arrival_and_ties(spark):
    rows = [("e1", 10, T0 + timedelta(seconds=5), "t", 0), ("e1", 11, T0 + timedelta(minutes=3), "t", 0), ("e2", 12, T0, "t", 0), ("e3", 7, T0, "t", 2), ("e3", 99, T0, "t", 0), (None, 1, T0, "t", 0), ("", 2, T0, "t", 0)]
    df = spark.createDataFrame(rows, "event_id string, offset long, ingested_at timestamp, topic string, partition int")
    assert sorted((r.event_id, r.offset) for r in dedup.first_arrival(df).collect()) == [("e1", 10), ("e2", 12), ("e3", 99)]


def test_latest_version(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, x string")
    assert sorted(r.x for r in dedup.latest_version(df, ["k"], "v").collect()) == ["y", "z"]


def test_session_gaps(spark):
    df = events(spark, [("1", "q", "s", "a", 0), ("2", "q", "s", "b", 10), ("3", "q", "s", "c", 30), ("4", "q", "s", "d", 60), ("5", "c", "s", "a", 5), ("6", "c", "only", "a", 5)])
    r = search.session_metrics(df).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.queries, r.clicks, r.avg_gap_seconds, r.span_seconds, r.queries_per_minute) == (4, 1, 20, 60, 4.0)
    assert r.stddev_gap_seconds == pytest.approx(8.165, abs=1e-3)


def test_single_query_session_has_no_rate(spark):
    r = search.session_metrics(events(spark, [("1", "q", "s", "a", 0)])).first()
    assert r.queries_per_minute is None and r.avg_gap_seconds is None and r.click_rate == 0


def test_top_queries_break_ties_by_text(spark):
    df = events(spark, [(str(i), "q", "s", q, i) for i, q in enumerate(["b", "a", "c", "c"])])
    assert [(r["rank"], r.query) for r in search.top_queries(df, 2).orderBy("rank").collect()] == [(1, "c"), (2, "a")]


def test_sessions_belong_to_the_day_they_began(spark):
    df = events(spark, [("1", "c", "s", "a", 86390), ("2", "q", "s", "a", 86410)])
    assert search.sessions_started_on(df, "2026-01-01").count() == 2 and search.day_events(df, "2026-01-01").count() == 1
    assert str(search.session_metrics(df).first().event_date) == "2026-01-01"


def features(spark, rows):
    cols = "session_id string, queries long, queries_per_minute double, avg_gap_seconds double, stddev_gap_seconds double, distinct_query_ratio double, click_rate double"
    return spark.createDataFrame(rows, cols)


def test_too_few_queries(spark):
    r = abuse.score_sessions(features(spark, [("s", 2, 50.0, 1.0, 0.0, 0.1, 0.0)])).first()
    assert (r.score, r.reasons, r.is_abusive) == (0.0, ["too_few_queries"], False)


def test_extreme_bots_do_not_mask_moderate_ones(spark):
    people = [(f"h{i}", 6, 1.0 + 0.02 * i, 50.0, 30.0, 0.95, 0.6) for i in range(30)]
    bots = [(f"x{i}", 120, 60.0, 1.0, 0.02, 0.05, 0.02) for i in range(5)] + [("m", 20, 8.0, 8.0, 0.8, 0.15, 0.05)]
    got = {r.session_id: r for r in abuse.score_sessions(features(spark, people + bots)).collect()}
    assert got["m"].speed > 0.5 and got["m"].is_abusive and not any(got[f"h{i}"].is_abusive for i in range(30))


def test_confusion_figures(spark):
    rows = [(f"s{i}", i < 10) for i in range(20)]
    scores = spark.createDataFrame(rows, "session_id string, is_abusive boolean")
    truth = spark.createDataFrame([(f"s{i}",) for i in range(2, 14)], "session_id string")
    r = abuse.evaluate(scores, truth).first()
    assert (r.tp, r.fp, r.fn) == (8, 2, 4) and r.precision == 0.8 and r.recall == pytest.approx(2 / 3) and r.f1 == pytest.approx(0.727, abs=1e-3)
    empty = abuse.evaluate(scores.filter("false"), truth).first()
    assert (empty.precision, empty.recall) == (1.0, 1.0)


def readings(spark, minutes_hot):
    rows = [(f"e{m}", "SH-1", "D-a", "pharma", "inland", 12.0 if hot else 5.0, T0 + timedelta(minutes=m)) for m, hot in minutes_hot]
    return spark.createDataFrame(rows, "event_id string, shipment_id string, device_id string, cargo_type string, leg string, temperature_c double, event_time timestamp")


def test_excursion_boundary(spark):
    e = sensor.excursions(readings(spark, [(m, 20 <= m <= 30) for m in range(0, 65, 5)])).collect()
    assert len(e) == 1 and e[0].duration_minutes == 15 and e[0].readings == 3 and e[0].start == T0 + timedelta(minutes=20)
    assert sensor.excursions(readings(spark, [(m, m == 20) for m in range(0, 65, 5)])).count() == 0
    assert sensor.excursions(readings(spark, [(m, m in (20, 25)) for m in range(0, 65, 5)])).count() == 0


def test_gap_and_no_excursion_across_it(spark):
    r = readings(spark, [(m, False) for m in (0, 5, 10, 15, 60, 65, 70, 75)])
    g = sensor.transmission_gaps(r).collect()
    assert len(g) == 1 and g[0].after == T0 + timedelta(minutes=15) and g[0].missing_minutes == 40
    assert sensor.transmission_gaps(readings(spark, [(0, False), (15, False)])).count() == 0
    assert sensor.excursions(readings(spark, [(m, True) for m in (0, 5, 40, 45)])).count() == 0


def test_order_fact(spark):
    def at(m):
        return T0 + timedelta(minutes=m)

    created = spark.createDataFrame([("O-1", at(0), "R", "control"), ("O-2", at(0), "R", "treatment"), ("O-3", at(0), "R", "control")], "order_id string, event_time timestamp, region_id string, experiment_variant string")
    cancel = spark.createDataFrame([("O-2", at(9), "no_rider")], "order_id string, event_time timestamp, cancel_reason string")
    sent = [("O-1", at(1), "d1", "r1", "rejected", None), ("O-1", at(2), "d2", "r2", "accepted", 20), ("O-1", at(3), "d3", "r3", "accepted", 10), ("O-9", at(1), "d9", "r", "accepted", 5)]
    sent = spark.createDataFrame(sent, "order_id string, event_time timestamp, dispatch_id string, rider_id string, result string, eta_minutes int")
    done = spark.createDataFrame([("O-1", at(30))], "order_id string, event_time timestamp")
    bad = spark.createDataFrame([("O-3", "x", "DispatchResult"), ("O-3", "x", "DispatchResult"), (None, "y", "DispatchResult")], "order_id string, event_id string, event_type string")
    got = {r.order_id: r for r in orders.order_fact(created, cancel, sent, done, bad).collect()}
    assert set(got) == {"O-1", "O-2", "O-3"}
    a = got["O-1"]
    assert (a.accepted_at, a.accepted_dispatch_id, a.eta_minutes, a.order_status, a.dispatch_attempts, a.dispatch_rejections) == (at(2), "d3", 10, "delivered", 3, 1)
    assert (a.actual_delivery_minutes, a.eta_error_minutes, a.minutes_to_first_dispatch) == (28.0, 18.0, 1.0)
    assert got["O-2"].order_status == "cancelled" and got["O-3"].order_status == "incomplete" and got["O-3"].rejected_dispatch_count == 1
    assert [r.order_id for r in orders.orphans({"dispatch": sent}, created).collect()] == ["O-9"]


def gate_names(spark, **change):
    facts = dict(session_rows=3000, sessions=3000, daily_rows=1, top_rows=20, top_ranks=20, score_rows=3000, scored=3000, flagged=168) | change
    df = spark.createDataFrame([tuple(facts.values())], list(facts))
    return {r.check_name for r in quality.gates(df).collect() if not r.passed}


def test_gates(spark):
    assert gate_names(spark) == set()
    assert gate_names(spark, session_rows=6000) == {"session_rows_unique", "abuse_covers_sessions"}
    assert gate_names(spark, session_rows=6000, score_rows=6000) == {"session_rows_unique", "abuse_covers_sessions"}
    assert gate_names(spark, flagged=601) == {"flagged_ratio_bounded"} and gate_names(spark, top_ranks=19) == {"top_query_ranks_unique"}
    assert "sessions_present" in gate_names(spark, session_rows=0, sessions=0, score_rows=0, scored=0, flagged=0)


def parsed_search(lines):
    checked = contracts.check(lines)
    from tidemark.operators import routing

    rows = routing.table_rows(checked.withColumnsRenamed({"event_id": "line_id"}), "raw_search_events")
    return checked, rows.withColumnRenamed("event_time", "event_ts").withColumn("event_date", F.to_date("event_ts"))


def test_search_ground_truth(spark):
    lines, truth, profiles = synth.search_log(spark, 2000)
    lines, truth = lines.cache(), truth.cache()
    checked, rows = parsed_search(lines)
    flagged = {r.line_id for r in checked.withColumnRenamed("event_id", "line_id").filter(F.size("violations") > 0).select("line_id").collect()}
    planted = {r.event_id for r in truth.filter("fault = 'invalid'").collect()}
    assert flagged and flagged <= planted
    assert {r.event_id for r in truth.filter("fault = 'invalid' AND how <> 'rank_zero'").collect()} <= flagged
    clean = dedup.earliest(rows, "event_id", "event_ts")
    scores = abuse.score_sessions(search.session_metrics(clean)).cache()
    bots = profiles.filter("profile <> 'human'")
    r = abuse.evaluate(scores, bots.select("session_id")).first()
    assert r.f1 >= 0.90 and r.precision >= 0.90 and r.recall >= 0.85
    by = {x.profile: x.share for x in scores.join(profiles, "session_id").groupBy("profile").agg(F.avg(F.col("is_abusive").cast("int")).alias("share")).collect()}
    assert by["aggressive"] >= 0.95 and by["stealth"] >= 0.70 and by["human"] < 0.01
    marks = {x.threshold: x.recall for x in abuse.sweep(scores, bots.select("session_id")).collect()}
    assert [marks[t] for t in sorted(marks)] == sorted(marks.values(), reverse=True)


def test_sensor_ground_truth(spark):
    lines, truth, facts = synth.sensor_log(spark, 120)
    checked = contracts.check(lines.withColumnRenamed("event_id", "line_id"))
    fields = {"shipment_id": "string", "device_id": "string", "cargo_type": "string", "leg": "string", "temperature_c": "double", "event_id": "string"}
    parsed = checked.select(*(F.expr(f"try_variant_get(event, '$.{k}', '{t}')").alias(k) for k, t in fields.items()), core.event_time(F.expr("try_variant_get(event, '$.event_time', 'string')")).alias("event_time"), "violations", "arrival")
    good, tally = sensor.clean(parsed.cache())
    counted = {r.reason: r.rows for r in tally.collect()}
    want = {r.fault: r.n for r in truth.groupBy("fault").agg(F.count("*").alias("n")).collect()}
    assert counted["duplicate"] == want["duplicate"] and sum(v for k, v in counted.items() if k != "duplicate") == want["invalid"]
    good = good.cache()
    hot = facts.filter("situation = 'excursion'").select("shipment_id", "start").collect()
    found = sensor.excursions(good)
    ids = {r.shipment_id for r in found.collect()}
    assert ids == {r.shipment_id for r in hot}  # no spike is reported
    gaps = {r.shipment_id for r in sensor.transmission_gaps(good).collect()}
    assert gaps == {r.shipment_id for r in facts.filter("situation IN ('dropout', 'offline')").collect()}
    again = sensor.clean(parsed.unionByName(parsed.limit(200).withColumn("arrival", F.col("arrival") + 1e6)).orderBy(F.rand(1)))[0]
    assert sensor.excursions(again).exceptAll(found).count() == 0
    assert sensor.excursion_summary(found).agg(F.sum("excursions")).first()[0] == found.count()


def test_delivery_ground_truth(spark):
    lines, truth = synth.delivery_log(spark, 300)
    bad = contracts.check(lines.withColumnRenamed("event_id", "line_id")).filter(F.size("violations") > 0)
    assert {r.line_id for r in bad.collect()} == {r.event_id for r in truth.filter("fault = 'invalid'").collect()}


def test_mix_guards():
    for bad in (lambda: synth.Faults(late=0.9, invalid=0.2), lambda: synth.SearchMix(bots=1.2), lambda: synth.SensorMix({"spike": 0.9, "dropout": 0.2})):
        with pytest.raises(ValueError):
            bad()


def test_sensor_scoring(spark):
    at = T0
    found = spark.createDataFrame([("SH-1", at), ("SH-2", at), ("SH-3", at)], "shipment_id string, start timestamp")
    gaps = spark.createDataFrame([("SH-4",), ("SH-4",), ("SH-5",), ("SH-6",)], "shipment_id string")
    truth = [("excursion", "SH-1", at), ("excursion", "SH-2", at + timedelta(minutes=5)), ("spike", "SH-3", at), ("dropout", "SH-4", at), ("dropout", "SH-7", at), ("offline", "SH-5", at)]
    r = sensor.score(found, gaps, spark.createDataFrame(truth, "situation string, shipment_id string, start timestamp")).first()
    assert r.excursion_precision == pytest.approx(1 / 3) and (r.excursion_recall, r.spikes_flagged, r.gap_recall, r.gap_false_alarms, r.offline_misreported_as_gap) == (0.5, 1, 0.5, 2, 1)
    empty = sensor.score(found.limit(0), gaps.limit(0), spark.createDataFrame([], "situation string, shipment_id string, start timestamp")).first()
    assert tuple(empty) == (1.0, 1.0, 0, 1.0, 0, 0)


def test_validator_scoring_and_recall_by_profile(spark):
    lines, truth = synth.delivery_log(spark, 800)
    flagged = contracts.check(lines.withColumnRenamed("event_id", "line_id")).filter(F.size("violations") > 0).select(F.col("line_id").alias("event_id"))
    r = contracts.score(flagged, truth.filter("fault = 'invalid'").select("event_id")).first()
    assert r.tp > 0 and (r.fp, r.fn, r.precision, r.recall) == (0, 0, 1.0, 1.0)
    assert {x.how for x in truth.filter("fault = 'invalid'").select("how").distinct().collect()} >= {"missing_dispatch", "non_positive_eta"}
    scores = spark.createDataFrame([("a", 0.9), ("b", 0.2), ("c", 0.7)], "session_id string, score double")
    profiles = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", "z")], "session_id string, profile string")
    got = {r.profile: (r.judged, r.caught, r.recall) for r in abuse.recall_by(scores, profiles).collect()}
    assert got == {"x": (2, 1, 0.5), "y": (1, 1, 1.0), "z": (0, 0, 0.0)}


def test_lenient_start():
    assert core.start_of("2026-09-25") == core.start_of("2026-09-25T00:00:00Z") == core.start_of("2026-09-25T09:00:00+09:00")
