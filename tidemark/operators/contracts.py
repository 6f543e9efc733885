"""Event contracts compiled to columns: each record of raw JSON gets its list of violations, without Python on the data path.

A contract is data: required fields, allowed fields with their rules, and fields required under a condition. The compiled program
parses a record once into a variant and tests presence by the object's keys and types by the variant's own type, so that a number in
quotes is not a number. Trailing text after an object, which lenient parsers skip, is found by parsing the record inside an array
whose last element is a fixed marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import event_time, ratio
from tidemark.session import spread

#: Closes the array that a record is parsed in.
MARK = "6f1d2a94-8c1e-4d0b-9b77-2f6f0a1f6e35"
VIOLATIONS = "array<struct<code:string,field:string,message:string>>"

INVALID_JSON, NOT_AN_OBJECT, MISSING_TYPE = "invalid_json", "not_an_object", "missing_event_type"
UNKNOWN_TYPE, SCHEMA, BAD_TIME = "unknown_event_type", "schema_violation", "invalid_event_time"

# Fixed values of the contracts.
_STR = {"type": "string"}
_ORDER_ID = {"type": "string", "pattern": "^O-[0-9]+$"}
_COMMON = {"schema_version": {"const": 1}, "event_id": _STR, "event_type": {}, "event_time": _STR}
_ORDER = _COMMON | {
    "order_id": _ORDER_ID,
    "region_id": _STR,
    "experiment_variant": {"enum": ["control", "treatment"]},
    "cancel_reason": {"enum": ["customer_request", "no_rider", "store_closed"]},
}
_SEARCH = _COMMON | {
    "session_id": {"type": "string", "pattern": "^S-[0-9a-f]+$"},
    "query": {"type": "string", "min_length": 1, "max_length": 200},
    "client": {"enum": ["web", "app"]},
    "result_count": {"type": "integer", "minimum": 0},
    "rank": {"type": "integer", "minimum": 1},
    "doc_id": _STR,
}
_DISPATCH = _COMMON | {"order_id": _ORDER_ID, "dispatch_id": _STR, "rider_id": _STR, "result": {"enum": ["accepted", "rejected"]}, "eta_minutes": {"type": "integer", "minimum": 1}}
_SENSOR = _COMMON | {
    "shipment_id": {"type": "string", "pattern": "^SH-[0-9]+$"},
    "device_id": {"type": "string", "pattern": "^D-[0-9a-f]+$"},
    "cargo_type": {"enum": ["pharma", "frozen"]},
    "leg": {"enum": ["warehouse", "inland", "international"]},
    "temperature_c": {"type": "number", "minimum": -80, "maximum": 80},
    "humidity_pct": {"type": "number", "minimum": 0, "maximum": 100},
}
_BASE = ["schema_version", "event_id", "event_type", "event_time"]
CONTRACTS: dict[str, dict] = {
    "OrderCreated": {"fields": _ORDER, "required": [*_BASE, "order_id", "region_id", "experiment_variant"]},
    "OrderCancelled": {"fields": _ORDER, "required": [*_BASE, "order_id", "cancel_reason"]},
    # an absent result doesn't contradict the condition, so eta_minutes is then required as well
    "DispatchResult": {"fields": _DISPATCH, "required": [*_BASE, "order_id", "dispatch_id", "rider_id", "result"], "when": ("result", "accepted", ["eta_minutes"])},
    "DeliveryCompleted": {"fields": _COMMON | {"order_id": _ORDER_ID, "dispatch_id": _STR}, "required": [*_BASE, "order_id", "dispatch_id"]},
    "SearchQuery": {"fields": _SEARCH, "required": [*_BASE, "session_id", "query", "result_count", "client"]},
    "SearchResultClick": {"fields": _SEARCH, "required": [*_BASE, "session_id", "query", "rank", "doc_id"]},
    "SensorReading": {"fields": _SENSOR, "required": [*_BASE, "shipment_id", "device_id", "cargo_type", "leg", "temperature_c"]},
}


def _v(code: str, field: str | None, message: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _has(field: str) -> Column:
    return F.array_contains("__keys", field)


def _rules(field: str, rule: dict) -> list[tuple[Column, str]]:
    """(holds, message) for each keyword of a field's rule."""
    kind, text = F.col(f"__kind_{field}"), F.col(f"__text_{field}")
    is_text, is_number = kind == "STRING", (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT")
    number = F.when(is_number, text.try_cast("double"))
    tests: list[tuple[Column, str]] = []
    match rule.get("type"):
        case "string":
            tests.append((is_text, "is not a string"))
        case "number":
            tests.append((is_number, "is not a number"))
        case "integer":
            tests.append((is_number & (number == F.floor(number)), "is not an integer"))
    if "const" in rule:
        tests.append((is_number & (number == float(rule["const"])), f"is not {rule['const']}"))
    if "enum" in rule:
        tests.append((is_text & text.isin(*rule["enum"]), "is not one of " + ", ".join(rule["enum"])))
    if "pattern" in rule:
        tests.append((~is_text | text.rlike(rule["pattern"].replace("$", "\\z")), f"does not match {rule['pattern']}"))
    if "min_length" in rule:
        tests.append((~is_text | (F.char_length(text) >= rule["min_length"]), f"is shorter than {rule['min_length']}"))
    if "max_length" in rule:
        tests.append((~is_text | (F.char_length(text) <= rule["max_length"]), f"is longer than {rule['max_length']}"))
    if "minimum" in rule:
        tests.append((~is_number | (number >= rule["minimum"]), f"is less than {rule['minimum']}"))
    if "maximum" in rule:
        tests.append((~is_number | (number <= rule["maximum"]), f"is more than {rule['maximum']}"))
    return tests


def _violations(contracts: dict[str, dict]) -> Column:
    """The violations of an object of a known type. A field's rule is tested once, for whichever types have the field."""
    kind = F.col("__type")
    found = []
    required = sorted({f for c in contracts.values() for f in c["required"]})
    for f in required:
        found.append(F.when(kind.isin(*(n for n, c in contracts.items() if f in c["required"])) & ~_has(f), _v(SCHEMA, f, f"{f} is required")))
    for name, c in contracts.items():
        if "when" in c:
            field, value, more = c["when"]
            applies = (kind == name) & (~_has(field) | ((F.col(f"__kind_{field}") == "STRING") & (F.col(f"__text_{field}") == value)))
            found += [F.when(F.coalesce(applies, F.lit(False)) & ~_has(f), _v(SCHEMA, f, f"{f} is required")) for f in more]
    rules: dict[str, dict[str, tuple[dict, list[str]]]] = {}
    for name, c in contracts.items():
        for f, rule in c["fields"].items():
            rules.setdefault(f, {}).setdefault(repr(rule), (rule, []))[1].append(name)
    for f, kinds in rules.items():
        for rule, names in kinds.values():
            for holds, says in _rules(f, rule):
                found.append(F.when(kind.isin(*names) & _has(f) & ~F.coalesce(holds, F.lit(False)), _v(SCHEMA, f, f"{f} {says}")))
    allowed = F.create_map(*(x for n, c in contracts.items() for x in (F.lit(n), F.array(*(F.lit(f) for f in c["fields"])))))
    extra = F.array_except("__keys", F.element_at(allowed, kind))
    found.append(F.when(F.size(extra) > 0, _v(SCHEMA, None, F.concat(F.lit("not allowed: "), F.array_join(extra, ", ")))))
    zoneless = (F.col("__kind_event_time") == "STRING") & event_time("__text_event_time").isNull()
    found.append(F.when(F.coalesce(zoneless, F.lit(False)), _v(BAD_TIME, "event_time", "event_time is not a time with a zone")))
    return F.array_compact(F.array(*found))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: a one-element inline keeps the optimizer from putting them into each of their uses."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def check(df: DataFrame, raw: str = "raw", contracts: dict[str, dict] = CONTRACTS) -> DataFrame:
    """df with event (variant; null if unreadable), event_type and violations (empty: accepted). raw is text, or bytes in UTF-8. A small df
    is dealt to all cores, as checking a record costs far more than moving it."""
    df = df if df.isStreaming else spread(df)
    source = F.col(raw)
    if dict(df.dtypes)[raw] == "binary":
        source = F.expr(f"try_validate_utf8(cast({raw} AS string))")
    inside = F.concat(F.lit("["), source, F.lit(f',"{MARK}"]'))
    df = _once(df, __all=F.try_parse_json(inside))
    readable = F.expr(f"coalesce(try_variant_get(__all, '$[1]', 'string') = '{MARK}' AND variant_get(__all, '$[2]', 'variant') IS NULL, false)")
    item = F.expr("variant_get(__all, '$[0]', 'variant')")
    df = _once(df, __ok=readable, __event=F.when(readable, item), __kind=F.schema_of_variant(item))
    object_ = F.coalesce(F.col("__ok") & F.col("__kind").startswith("OBJECT<"), F.lit(False))
    kind_of = "schema_of_variant(variant_get(__event, '$.{}', 'variant'))".format
    text_of = "try_variant_get(__event, '$.{}', 'string')".format
    keys = F.array_distinct(F.coalesce(F.json_object_keys(source), F.array().cast("array<string>")))
    empty = F.array().cast("array<string>")
    df = _once(df, __object=object_, __keys=F.when(object_, keys).otherwise(empty), __kind_event_type=F.expr(kind_of("event_type")), __text_event_type=F.expr(text_of("event_type")))
    df = _once(df, __type=F.when(F.col("__kind_event_type") == "STRING", F.col("__text_event_type")))
    each = {}
    for f in sorted({f for c in contracts.values() for f in c["fields"]} - {"event_type"}):  # taken from the types that have it only
        known = F.col("__type").isin(*(n for n, c in contracts.items() if f in c["fields"]))
        each[f"__kind_{f}"], each[f"__text_{f}"] = F.when(known, F.expr(kind_of(f))), F.when(known, F.expr(text_of(f)))
    df = _once(df, **each)
    missing = ~_has("event_type") | (F.col("__kind_event_type") == "VOID")
    out = (
        F.when(~F.col("__ok"), F.array(_v(INVALID_JSON, None, "not readable as JSON")))
        .when(~F.col("__object"), F.array(_v(NOT_AN_OBJECT, None, "not a JSON object")))
        .when(F.coalesce(missing, F.lit(True)), F.array(_v(MISSING_TYPE, "event_type", "event_type is missing")))
        .when(~F.coalesce(F.col("__type").isin(*contracts), F.lit(False)), F.array(_v(UNKNOWN_TYPE, "event_type", "event_type is not known")))
        .otherwise(_violations(contracts).cast(VIOLATIONS))
    )
    df = _once(df, violations=F.coalesce(out.cast(VIOLATIONS), F.array().cast(VIOLATIONS)), event=F.expr("CASE WHEN __object THEN __event END"))
    own = [c for c in df.columns if not c.startswith("__") and c != "event_type"]
    return df.select(*own, F.col("__type").alias("event_type"))


def dead_letters(checked: DataFrame, *coordinates: str, raw: str = "raw") -> DataFrame:
    """One row for each violation: coordinates, event_id and event_type where they are strings, reason_code, field, message, raw."""
    event_id = F.expr("CASE WHEN schema_of_variant(variant_get(event, '$.event_id', 'variant')) = 'STRING' THEN try_variant_get(event, '$.event_id', 'string') END")
    kept = F.expr(f"make_valid_utf8(cast({raw} AS string))")
    flat = checked.filter(F.size("violations") > 0).select(*coordinates, event_id.alias("event_id"), "event_type", kept.alias("raw"), F.explode("violations").alias("v"))
    return flat.select(*coordinates, "event_id", "event_type", F.col("v.code").alias("reason_code"), F.col("v.field").alias("field"), F.col("v.message").alias("message"), "raw")


def tally(checked: DataFrame) -> DataFrame:
    """reason, rows: rejected records by their first violation."""
    return checked.filter(F.size("violations") > 0).groupBy(F.col("violations")[0]["code"].alias("reason")).agg(F.count("*").alias("rows"))


def counters(checked: DataFrame) -> DataFrame:
    """consumed, accepted, rejected, and the number of violations by code."""
    codes = (INVALID_JSON, NOT_AN_OBJECT, MISSING_TYPE, UNKNOWN_TYPE, SCHEMA, BAD_TIME)
    ok = F.size("violations") == 0
    given = F.transform("violations", lambda v: v["code"])
    per = [F.coalesce(F.sum(F.size(given) - F.size(F.array_remove(given, code))), F.lit(0)).alias(code) for code in codes]
    return checked.agg(F.count("*").alias("consumed"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), *per)


def score(flagged: DataFrame, planted: DataFrame, key: str = "event_id") -> DataFrame:
    """One row: tp, fp, fn, precision and recall of the flagged keys against the planted ones; 1 where a denominator is empty."""
    found = flagged.select(key).distinct().withColumn("__found", F.lit(True))
    wanted = planted.select(key).distinct().withColumn("__planted", F.lit(True))
    both = found.join(wanted, key, "full_outer").select(F.coalesce("__found", F.lit(False)).alias("f"), F.coalesce("__planted", F.lit(False)).alias("p"))
    counts = both.agg(F.count_if(F.col("f") & F.col("p")).alias("tp"), F.count_if(F.col("f") & ~F.col("p")).alias("fp"), F.count_if(~F.col("f") & F.col("p")).alias("fn"))
    return counts.withColumns({"precision": F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), F.lit(1.0)), "recall": F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), F.lit(1.0))})
