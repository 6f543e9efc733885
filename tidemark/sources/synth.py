"""Synthetic events with known faults, for tests: every draw is a hash of (id, purpose, seed), so results do not depend on partitioning.

Each generator returns (lines, truth): lines has raw JSON with arrival (seconds) and its event_id; truth names what was planted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START = "2026-01-05 00:00:00"
# Leg lengths in readings and temperature ranges.
LEGS = {"warehouse": (12, 36), "inland": (24, 60), "international": (48, 96)}
RANGES = {"pharma": (2.0, 8.0), "frozen": (-25.0, -15.0)}


def _share(name: str, x: float) -> None:
    if not 0 <= x <= 1:
        raise ValueError(f"{name} must be within [0, 1]: {x}")


@dataclass(frozen=True)
class Faults:
    duplicate: float = 0.03
    late: float = 0.05
    out_of_order: float = 0.02
    invalid: float = 0.01

    def __post_init__(self):
        for k in ("duplicate", "late", "out_of_order", "invalid"):
            _share(k, getattr(self, k))
        if self.late + self.out_of_order + self.invalid > 1:
            raise ValueError("late, out_of_order and invalid exclude each other; their sum must be at most 1")


@dataclass(frozen=True)
class SearchMix:
    bots: float = 0.05
    stealth: float = 0.4

    def __post_init__(self):
        _share("bots", self.bots)
        _share("stealth", self.stealth)


@dataclass(frozen=True)
class SensorMix:
    situations: dict[str, float] = field(default_factory=lambda: {"excursion": 0.10, "spike": 0.10, "dropout": 0.05, "offline": 0.05})

    def __post_init__(self):
        for k, v in self.situations.items():
            _share(k, v)
        if sum(self.situations.values()) > 1:
            raise ValueError("the mix must sum to at most 1")


def draw(seed: int, *parts) -> Column:
    """Uniform in [0, 1) from a hash of the parts."""
    cols = [F.lit(p) if isinstance(p, str) and p.startswith("#") else F.col(p) if isinstance(p, str) else p for p in parts]
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def between(low: float, high: float, u: Column) -> Column:
    return F.lit(low) + u * (high - low)


def _faulty(events: DataFrame, seed: int, rates: Faults, corrupt: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """events: event_id, at (seconds), child, body (struct). Adds late, early and repeated arrivals and broken contracts; corrupt: name, the
    broken record and, unless it can befall any event, when it can."""
    one = draw(seed, "event_id", F.lit("fault"))
    kind = F.when(~F.col("child"), "none").when(one < rates.late, "late").when(one < rates.late + rates.out_of_order, "out_of_order").when(one < rates.late + rates.out_of_order + rates.invalid, "invalid").otherwise("none")
    rows = events.withColumn("fault", kind)
    shift = F.when(F.col("fault") == "late", between(600, 7200, draw(seed, "event_id", F.lit("late")))).when(F.col("fault") == "out_of_order", -between(60, 600, draw(seed, "event_id", F.lit("early")))).otherwise(between(0, 2, draw(seed, "event_id", F.lit("jitter"))))
    plain = F.to_json("body")
    # of the faults that an event can have, one
    options = F.array_compact(F.array(*(F.when(can, F.struct(F.lit(name).alias("how"), text.alias("raw"))) for name, text, can in ((*c, F.lit(True))[:3] for c in corrupt))))
    chosen = F.element_at(options, (F.floor(draw(seed, "event_id", F.lit("how")) * F.size(options)) + 1).cast("int"))
    bad = F.col("fault") == "invalid"
    rows = rows.withColumn("chosen", F.when(bad, chosen)).select("event_id", (F.col("at") + shift).alias("arrival"), F.when(bad, F.col("chosen.raw")).otherwise(plain).alias("raw"), "fault", F.col("chosen.how").alias("how"))
    again = rows.filter((draw(seed, "event_id", F.lit("again")) < rates.duplicate) & (F.col("fault") != "invalid"))
    resent = again.withColumns({"arrival": F.col("arrival") + between(1, 300, draw(seed, "event_id", F.lit("resent"))), "fault": F.lit("duplicate")})
    truth = rows.filter("fault <> 'none'").select("event_id", "fault", "how").unionByName(resent.select("event_id", "fault", "how"))
    return rows.unionByName(resent).select("event_id", "arrival", "raw"), truth


def _time(at: Column) -> Column:
    return F.date_format((F.unix_timestamp(F.lit(START)) + F.floor(at)).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _body(kind: Column, fields: dict[str, Column]) -> Column:
    head = {"schema_version": F.lit(1), "event_id": F.col("event_id"), "event_type": kind, "event_time": _time(F.col("at"))}
    return F.struct(*(c.alias(k) for k, c in (head | fields).items()))


def _broken(*drop: str, **put: Column) -> Column:
    """The body as JSON without some fields or with others; nulls are not written."""
    body = F.col("body")
    for k in drop:
        body = body.withField(k, F.lit(None).cast("string"))
    for k, v in put.items():
        body = body.withField(k, v)
    return F.to_json(body)


def search_log(spark: SparkSession, sessions: int, seed: int = 21, rates: Faults = Faults(), mix: SearchMix = SearchMix()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, truth, profiles): people ask 1-6 times with pauses; aggressive bots 40-200 times within seconds; stealth bots 8-25 times."""
    s = spark.range(sessions).select(F.format_string("S-%08x", "id").alias("session_id"), "id")
    bot = draw(seed, "id", F.lit("bot")) < mix.bots
    profile = F.when(~bot, "human").when(draw(seed, "id", F.lit("kind")) < mix.stealth, "stealth").otherwise("aggressive")
    s = s.withColumn("profile", profile).withColumn("begin", between(0, 80_000, draw(seed, "id", F.lit("begin"))))
    u = draw(seed, "id", F.lit("n"))
    n = F.when(F.col("profile") == "human", between(1, 7, u)).when(F.col("profile") == "stealth", between(8, 26, u)).otherwise(between(40, 201, u)).cast("int")
    pace = between(0.0, 1.0, draw(seed, "id", F.lit("pace")))
    s = s.withColumns({"n": n, "pace": F.when(F.col("profile") == "aggressive", 0.5 + 2.5 * pace).otherwise(5 + 20 * pace)})
    q = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    gap_u = draw(seed, "id", "k", F.lit("gap"))
    gap = F.when(F.col("profile") == "human", between(20, 120, gap_u)).when(F.col("profile") == "stealth", F.col("pace") * between(0.5, 1.8, gap_u)).otherwise(F.col("pace") * between(0.95, 1.05, gap_u))
    q = q.withColumn("gap", F.when(F.col("k") == 0, 0.0).otherwise(gap))
    q = q.withColumn("at", F.col("begin") + F.sum("gap").over(Window.partitionBy("id").orderBy("k")))
    pool = F.when(F.col("profile") == "human", F.lit(5000)).when(F.col("profile") == "stealth", F.lit(4)).otherwise(F.lit(3))
    word = F.floor(draw(seed, "id", "k", F.lit("word")) * pool).cast("int")
    text = F.when(F.col("profile") == "human", F.format_string("word %d", word)).otherwise(F.format_string("target %d", F.pmod(F.col("id"), F.lit(40)).cast("int") * 10 + word))
    q = q.withColumns({"query": text, "event_id": F.format_string("q-%d-%d", "id", "k"), "client": F.when(F.pmod("id", F.lit(2)) == 0, "web").otherwise("app")})
    rate = F.when(F.col("profile") == "human", 0.6).when(F.col("profile") == "stealth", 0.25).otherwise(0.04)
    c = q.filter(draw(seed, "id", "k", F.lit("click")) < rate)
    results = F.floor(draw(seed, "id", "k", F.lit("results")) * 50).cast("int")
    none = F.lit(None)
    asked = q.select("event_id", "at", (F.col("k") > 0).alias("child"), _body(F.lit("SearchQuery"), {"session_id": F.col("session_id"), "query": F.col("query"), "client": F.col("client"), "result_count": results, "rank": none.cast("int"), "doc_id": none.cast("string")}).alias("body"))
    c = c.withColumns({"event_id": F.format_string("c-%d-%d", "id", "k"), "at": F.col("at") + between(0.2, 0.9, draw(seed, "id", "k", F.lit("dwell"))) * F.when(F.col("profile") == "human", 10).otherwise(0.5)})
    rank = (1 + F.floor(draw(seed, "id", "k", F.lit("rank")) * F.when(F.col("profile") == "aggressive", 1).otherwise(10))).cast("int")
    clicked = c.select("event_id", "at", F.lit(True).alias("child"), _body(F.lit("SearchResultClick"), {"session_id": F.col("session_id"), "query": F.col("query"), "client": none.cast("string"), "result_count": none.cast("int"), "rank": rank, "doc_id": F.format_string("d-%d", "k")}).alias("body"))
    corrupt = [("missing_session", _broken("session_id")), ("empty_query", _broken(query=F.lit(""))), ("rank_zero", _broken(rank=F.lit(0))), ("bad_time", _broken(event_time=F.lit("2026-13-45T25:61:00Z")))]
    lines, truth = _faulty(asked.unionByName(clicked), seed, rates, corrupt)
    return lines, truth, s.select("session_id", "profile")


def delivery_log(spark: SparkSession, orders: int, seed: int = 21, rates: Faults = Faults()) -> tuple[DataFrame, DataFrame]:
    """(lines, truth): each order is created, dispatched up to three times, then delivered, cancelled or left open."""
    o = spark.range(orders).select("id", F.format_string("O-%d", "id").alias("order_id"), between(0, 80_000, draw(seed, "id", F.lit("begin"))).alias("t0"), F.when(draw(seed, "id", F.lit("arm")) < 0.5, "control").otherwise("treatment").alias("variant"))
    accept = F.when(F.col("variant") == "treatment", 0.82).otherwise(0.75)
    tries = o.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("ok", draw(seed, "id", "k", F.lit("accept")) < accept)
    first = F.min(F.when(F.col("ok"), F.col("k"))).over(Window.partitionBy("id"))
    tries = tries.withColumn("won", first).filter(F.col("won").isNull() | (F.col("k") <= F.col("won")))
    tries = tries.withColumns({"at": F.col("t0") + (F.col("k") + 1) * between(60, 240, draw(seed, "id", F.lit("step"))), "eta": (15 + F.floor(draw(seed, "id", "k", F.lit("eta")) * 26)).cast("int"), "event_id": F.format_string("d-%d-%d", "id", "k")})
    none = F.lit(None).cast("string")

    def fields(**own: Column) -> dict[str, Column]:
        names = {k: none for k in ("region_id", "experiment_variant", "cancel_reason", "dispatch_id", "rider_id", "result")} | {"eta_minutes": F.lit(None).cast("int")}
        return {"order_id": F.col("order_id")} | names | own

    made = o.withColumns({"event_id": F.format_string("o-%d", "id"), "at": F.col("t0")})
    made = made.select("event_id", "at", F.lit(False).alias("child"), _body(F.lit("OrderCreated"), fields(region_id=F.format_string("R%d", F.floor(draw(seed, "id", F.lit("region")) * 5).cast("int")), experiment_variant=F.col("variant"))).alias("body"))
    ids = {"dispatch_id": F.format_string("x-%d-%d", "id", "k"), "rider_id": F.format_string("r-%d", F.floor(draw(seed, "id", "k", F.lit("rider")) * 200).cast("int"))}
    sent = tries.select("event_id", "at", F.lit(True).alias("child"), _body(F.lit("DispatchResult"), fields(**ids, result=F.when(F.col("ok"), "accepted").otherwise("rejected"), eta_minutes=F.when(F.col("ok"), F.col("eta")))).alias("body"))
    won = tries.filter("ok").withColumn("stop", draw(seed, "id", F.lit("stop")) < 0.03)
    took = F.greatest(F.lit(5.0), F.col("eta") + (draw(seed, "id", F.lit("off")) - 0.5) * 20) * 60
    done = won.filter("NOT stop").withColumns({"event_id": F.format_string("v-%d", "id"), "at": F.col("at") + took})
    done = done.select("event_id", "at", F.lit(True).alias("child"), _body(F.lit("DeliveryCompleted"), fields(dispatch_id=ids["dispatch_id"])).alias("body"))
    lost = tries.filter("won IS NULL AND k = 2").withColumn("why", F.lit("no_rider")).unionByName(won.filter("stop").withColumn("why", F.lit("customer_request")).drop("stop"))
    lost = lost.withColumns({"event_id": F.format_string("z-%d", "id"), "at": F.col("at") + 120})
    gone = lost.select("event_id", "at", F.lit(True).alias("child"), _body(F.lit("OrderCancelled"), fields(cancel_reason=F.col("why"))).alias("body"))
    corrupt = [("missing_order", _broken("order_id")), ("bad_time", _broken(event_time=F.lit("2026-13-45T25:61:00Z"))), ("odd_version", _broken(schema_version=F.lit(2))), ("missing_dispatch", _broken("dispatch_id"), F.col("body.dispatch_id").isNotNull()), ("non_positive_eta", _broken(eta_minutes=F.lit(0)), F.col("body.eta_minutes").isNotNull())]
    return _faulty(made.unionByName(sent).unionByName(done).unionByName(gone), seed, rates, corrupt)


def sensor_log(spark: SparkSession, shipments: int, seed: int = 21, rates: Faults = Faults(), mix: SensorMix = SensorMix()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, truth, situations): a reading every five minutes over three legs; some shipments have an excursion, a spike or a gap."""
    s = spark.range(shipments).select("id", F.format_string("SH-%d", "id").alias("shipment_id"), F.format_string("D-%x", "id").alias("device_id"), F.when(draw(seed, "id", F.lit("cargo")) < 0.5, "pharma").otherwise("frozen").alias("cargo_type"))
    u, total, case = draw(seed, "id", F.lit("what")), 0.0, None
    for k, p in mix.situations.items():
        total += p
        case = F.when(u < total, k) if case is None else case.when(u < total, k)
    s = s.withColumn("situation", case.otherwise("normal"))
    ends = []
    for leg, (a, b) in LEGS.items():
        ends.append((leg, between(a, b + 1, draw(seed, "id", F.lit(leg))).cast("int")))
    s = s.withColumns({f"n_{leg}": n for leg, n in ends})
    n1, n2, n = F.col("n_warehouse"), F.col("n_warehouse") + F.col("n_inland"), F.col("n_warehouse") + F.col("n_inland") + F.col("n_international")
    # the situation lies away from the ends; an offline stretch begins at the hand-over to the second leg
    width = between(4, 19, draw(seed, "id", F.lit("width"))).cast("int")
    where = F.when(F.col("situation") == "offline", n1).otherwise((5 + draw(seed, "id", F.lit("where")) * (n - 30)).cast("int"))
    width = F.when(F.col("situation") == "spike", 1).when(F.col("situation").isin("dropout", "offline"), between(6, 18, draw(seed, "id", F.lit("hole"))).cast("int")).otherwise(width)
    s = s.withColumns({"n": n, "from": where, "width": width, "t0": F.floor(between(0, 20_000, draw(seed, "id", F.lit("begin"))))})
    r = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    within = (F.col("k") >= F.col("from")) & (F.col("k") < F.col("from") + F.col("width"))
    r = r.filter(~(within & F.col("situation").isin("dropout", "offline")))
    mid = F.when(F.col("cargo_type") == "pharma", 5.0).otherwise(-20.0)
    hot = within & F.col("situation").isin("excursion", "spike")
    temp = F.round(mid + (draw(seed, "id", "k", F.lit("noise")) - 0.5) * 3 + F.when(hot, 9.0).otherwise(0.0), 2)
    leg = F.when(F.col("k") < n1, "warehouse").when(F.col("k") < n2, "inland").otherwise("international")
    r = r.withColumns({"event_id": F.format_string("t-%d-%d", "id", "k"), "at": F.col("t0") + F.col("k") * 300})
    body = _body(F.lit("SensorReading"), {"shipment_id": F.col("shipment_id"), "device_id": F.col("device_id"), "cargo_type": F.col("cargo_type"), "leg": leg, "temperature_c": temp})
    corrupt = [("missing_device", _broken("device_id")), ("sensor_error", _broken(temperature_c=F.lit(-999.0))), ("bad_time", _broken(event_time=F.lit("2026-13-45T25:61:00Z")))]
    lines, truth = _faulty(r.select("event_id", "at", F.lit(True).alias("child"), body.alias("body")), seed, rates, corrupt)
    base = F.unix_timestamp(F.lit(START))
    facts = s.select("shipment_id", "situation", (base + F.col("t0") + F.col("from") * 300).cast("timestamp").alias("start"), (base + F.col("t0") + (F.col("from") + F.col("width") - 1) * 300).cast("timestamp").alias("end"), "width")
    return lines, truth, facts
