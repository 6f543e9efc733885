"""Contract cases: expected (code, field) pairs."""

import json

import pytest

from tidemark.operators import contracts, routing

ORDER = {"schema_version": 1, "event_id": "e1", "event_type": "OrderCreated", "order_id": "O-1", "event_time": "2026-01-01T00:00:00Z", "region_id": "R1", "experiment_variant": "control"}
CANCEL = {"schema_version": 1, "event_id": "e2", "event_type": "OrderCancelled", "order_id": "O-1", "event_time": "2026-01-01T00:00:00Z", "cancel_reason": "no_rider"}
DISPATCH = {"schema_version": 1, "event_id": "e3", "event_type": "DispatchResult", "order_id": "O-1", "dispatch_id": "x", "rider_id": "r", "result": "accepted", "eta_minutes": 35, "event_time": "2026-01-01T00:00:00+09:00"}
QUERY = {"schema_version": 1, "event_id": "e4", "event_type": "SearchQuery", "session_id": "S-0a", "query": "x", "result_count": 0, "client": "web", "event_time": "2026-01-01T00:00:00.5Z"}
SENSOR = {"schema_version": 1, "event_id": "e5", "event_type": "SensorReading", "shipment_id": "SH-1", "device_id": "D-a", "cargo_type": "pharma", "leg": "inland", "temperature_c": 4, "event_time": "2026-01-01T00:00:00Z"}
S = "schema_violation"


def put(base, **change):
    d = {**base, **change}
    return json.dumps({k: v for k, v in d.items() if v is not ...})


CASES = [
    (put(ORDER), []), (put(CANCEL), []), (put(DISPATCH), []), (put(QUERY), []), (put(SENSOR), []),
    (put(DISPATCH, result="rejected", eta_minutes=...), []), (put(DISPATCH, eta_minutes=35.0), []),
    ('{"schema_version":1', [("invalid_json", None)]), ("", [("invalid_json", None)]), (put(ORDER) + " x", [("invalid_json", None)]),
    (put(ORDER) + "," + put(ORDER), [("invalid_json", None)]), ("{} {}", [("invalid_json", None)]), ("]", [("invalid_json", None)]),
    ("[1]", [("not_an_object", None)]), ("3", [("not_an_object", None)]), ('"x"', [("not_an_object", None)]), ("null", [("not_an_object", None)]),
    (put(ORDER, event_type=...), [("missing_event_type", "event_type")]), (put(ORDER, event_type=None), [("missing_event_type", "event_type")]),
    (put(ORDER, event_type="Nope"), [("unknown_event_type", "event_type")]), (put(ORDER, event_type=["OrderCreated"]), [("unknown_event_type", "event_type")]),
    (put(ORDER, order_id=...), [(S, "order_id")]), (put(ORDER, order_id="ABC"), [(S, "order_id")]), (put(ORDER, order_id="O-1\n"), [(S, "order_id")]),
    (put(ORDER, schema_version=2), [(S, "schema_version")]), (put(ORDER, region_id=...), [(S, "region_id")]), (put(ORDER, experiment_variant="b"), [(S, "experiment_variant")]),
    (put(CANCEL, cancel_reason=...), [(S, "cancel_reason")]), (put(DISPATCH, eta_minutes=0), [(S, "eta_minutes")]), (put(DISPATCH, eta_minutes="35"), [(S, "eta_minutes")]),
    (put(DISPATCH, eta_minutes=...), [(S, "eta_minutes")]), (put(DISPATCH, result="maybe"), [(S, "result")]), (put(DISPATCH, result=..., eta_minutes=...), [(S, "result"), (S, "eta_minutes")]),
    (put(ORDER, extra=1, more=2), [(S, None)]), (put(ORDER, order_id=..., event_id=...), [(S, "order_id"), (S, "event_id")]),
    (put(ORDER, event_time="2026-13-45T25:61:00Z"), [("invalid_event_time", "event_time")]), (put(ORDER, event_time="2026-01-01T00:00:00"), [("invalid_event_time", "event_time")]),
    (put(ORDER, event_time="2026"), [("invalid_event_time", "event_time")]), (put(ORDER, event_time="T00:00:00Z"), [("invalid_event_time", "event_time")]), (put(ORDER, event_time="2026-01-01T00:00Z"), []),
    (put(ORDER, event_time=5), [(S, "event_time")]), (put(ORDER, order_id=..., event_time="no"), [(S, "order_id"), ("invalid_event_time", "event_time")]),
    (put(QUERY, query=""), [(S, "query")]), (put(QUERY, query="x" * 201), [(S, "query")]), (put(QUERY, query="x" * 200), []), (put(SENSOR, temperature_c=-999), [(S, "temperature_c")]),
    (put(SENSOR, humidity_pct=101), [(S, "humidity_pct")]), (put(QUERY, result_count=True), [(S, "result_count")]), (put(ORDER, event_id=None), [(S, "event_id")]),
]


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(i, "t", 0, i, raw) for i, (raw, _) in enumerate(CASES)]
    return contracts.check(spark.createDataFrame(rows, "n int, topic string, partition int, offset long, raw string")).cache()


def test_codes_and_fields(checked):
    got = {r.n: sorted(((v.code, v.field) for v in r.violations), key=str) for r in checked.collect()}
    wrong = {CASES[i][0]: (got[i], want) for i, (_, want) in enumerate(CASES) if got[i] != sorted(want, key=str)}
    assert not wrong


def test_bytes_that_are_not_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xfe{}"),), (bytearray(put(ORDER).encode()),), (None,)], "raw binary")
    got = [[v.code for v in r.violations] for r in contracts.check(df).collect()]
    assert got == [["invalid_json"], [], ["invalid_json"]]


def test_duplicate_keys_take_the_last(spark):
    raw = put(ORDER)[:-1] + ',"region_id":"R9"}'
    checked = contracts.check(spark.createDataFrame([(raw,)], "raw string"))
    assert routing.table_rows(checked, "raw_order_events").first().region_id == "R9"


def test_dead_letters_and_counters(checked):
    dlq = contracts.dead_letters(checked, "offset")
    both = {r.reason_code for r in dlq.filter("raw like '%\"no\"%'").collect()}
    assert both == {"schema_violation", "invalid_event_time"}
    c = contracts.counters(checked).first()
    assert c.consumed == len(CASES) and c.accepted == sum(not want for _, want in CASES) and c.accepted + c.rejected == c.consumed


def test_routing(checked):
    tables = routing.route(checked)
    assert sum(t.count() for t in tables.values()) == sum(not want for _, want in CASES)
    dispatch = tables["raw_dispatch_events"].orderBy("offset").collect()
    assert str(dispatch[0].event_time) == "2025-12-31 15:00:00" and dispatch[0].eta_minutes == 35
    assert dispatch[1].eta_minutes is None
    assert tables["raw_sensor_events"].first().temperature_c == 4.0
