"""Tape-shaped views over the driver tables (column mappings only)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import ntz_us
from ..profile import DAY_US, DEFAULT, Profile

MINUTE_US = 60_000_000

# A unit is ten minutes, a macro bar half an hour, a session 04:00-24:00 UTC.
EVENTS_PROFILE: Profile = replace(
    DEFAULT,
    unit_us=10 * MINUTE_US,
    macro_us=30 * MINUTE_US,
    session_macros=40,
    gap_cap=12,
    opening_range_macros=3,
    premarket_us=4 * 60 * MINUTE_US,
    lookup_lead_us=4 * 60 * MINUTE_US,
    midday_from=8,
    midday_to=32,
    late_grace=6.0,
    replay_slack=8.0,
    backfill_gap=3.0,
    feed_latency_max=5.0,
    context_stale=12.0,
    context_short=6,
    context_long=18,
    context_clamp=200.0,
    ready_bps=8.0,
    break_max_bps=40.0,
    break_max_open_bps=60.0,
    open_phase_min=3.0,
    vel_min_bps_s=0.5,
    vel15_max_bps_s=6.0,
    vol_accel_min=1.0,
    vol_base_min=0.5,
    imb_min=0.10,
    imb15_min=0.02,
    persist_min_trades=1,
    persist_min_span_s=0.0,
    min_trades_2s=1,
    single_print_max_frac=1.0,
    score_min=0.35,
    sweep_window_s=24.0,
    sweep_max_bps=60.0,
    confirm_min_s=6.0,
    observe_max_s=9.0,
    cooldown_failed_s=6.0,
    cooldown_confirmed_s=12.0,
    cooldown_suppressed_s=8.0,
    burst_window_s=3.0,
    hour_window_s=18.0,
    min_gap_same_symbol_s=3.0,
    trend_window_s=12,
    trend_min_bps=25.0,
    trend_dir_share_min=0.55,
    trend_vol_base_min=0.5,
    trend_extreme_min=6,
    outcome_window_s=18,
    min_labels=20,
    quiet_last_us=60 * MINUTE_US,
)
EVENTS_OPEN_US = 4 * 60 * MINUTE_US

# Fixed demonstration mapping: condition codes by last digit of the user id.
EVENT_CONDITIONS = (
    ("@",),
    ("@", "F"),
    (),
    ("@", "I"),
    ("@",),
    ("F",),
    ("M",),
    ("@", "T"),
    ("W",),
    ("@",),
)
# Each event is a print of its own symbol and a quote for the paired one.
QUOTE_PAIR = {
    "click": "view",
    "view": "purchase",
    "purchase": "signup",
    "signup": "error",
    "error": "click",
}
MARKET, FEAR = "view", "error"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _conditions():
    arrays = [
        F.array(*[F.lit(c) for c in codes]).cast("array<string>") for codes in EVENT_CONDITIONS
    ]
    return F.element_at(F.array(*arrays), (F.col("user_id") % 10 + 1).cast("int"))


def events_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw prints: one per event, with arrival time, venue and condition codes."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, sf_dir, "events").withColumn("ts_us", ntz_us(F.col("ts")))
    session = F.expr(f"ts_us div {DAY_US}")
    return e.select(
        F.col("event_type").alias("symbol"),
        session.alias("session"),
        "ts_us",
        F.col("event_id").alias("seq"),
        F.when(F.col("value") > 0, F.round(100 + F.col("value") / 100, 4))
        .otherwise(F.lit(0.0))
        .alias("price"),
        k.alias("size"),
        _conditions().alias("conditions"),
        (F.col("ts_us") + k * MINUTE_US).alias("arr_us"),
        (F.col("user_id") % 4).alias("exchange"),
        F.col("event_id").alias("trade_id"),
        (session * DAY_US + EVENTS_OPEN_US).alias("open_us"),
        ((session + 1) * DAY_US).alias("close_us"),
    )


def events_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes: every event quotes the paired symbol, half a currency unit wide."""
    e = table(spark, sf_dir, "events").withColumn("ts_us", ntz_us(F.col("ts")))
    pair = F.create_map(*[F.lit(x) for kv in QUOTE_PAIR.items() for x in kv])
    mid = 100 + F.col("value") / 100
    return e.select(
        pair[F.col("event_type")].alias("symbol"),
        F.expr(f"ts_us div {DAY_US}").alias("session"),
        "ts_us",
        F.col("event_id").alias("seq"),
        F.when(F.col("value") > 0, F.round(mid - 0.25, 4)).otherwise(F.lit(0.0)).alias("bid"),
        F.get_json_object("props", "$.k").cast("bigint").alias("bid_size"),
        F.round(mid + 0.25, 4).alias("ask"),
        (F.col("user_id") % 100 + 1).alias("ask_size"),
    )


def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tape day: (session, open_us, close_us)."""
    day = F.expr(f"ts_us div {DAY_US}")
    return (
        table(spark, sf_dir, "events")
        .select(ntz_us(F.col("ts")).alias("ts_us"))
        .groupBy(day.alias("session"))
        .agg(F.count("*").alias("_n"))
        .select(
            "session",
            (F.col("session") * DAY_US + EVENTS_OPEN_US).alias("open_us"),
            ((F.col("session") + 1) * DAY_US).alias("close_us"),
        )
    )


# A warmed-up tape starts so many macro bars after the open, by session number.
START_MACROS = (0, 2, 10)


def events_starts(sessions: DataFrame, p: Profile = EVENTS_PROFILE) -> DataFrame:
    late = F.element_at(F.array(*[F.lit(n * p.macro_us) for n in START_MACROS]), (F.col("session") % len(START_MACROS) + 1).cast("int"))
    return sessions.select("session", (F.col("open_us") + late).alias("start_us"))


def events_hist(spark: SparkSession, sf_dir: str, width_us: int) -> DataFrame:
    """Historical bars of the given width over the events, as a vendor would send them."""
    e = table(spark, sf_dir, "events").filter("value > 0").withColumn("at", ntz_us(F.col("ts")))
    size = F.get_json_object("props", "$.k").cast("bigint")
    rows = e.select(
        F.col("event_type").alias("symbol"),
        F.expr(f"at div {width_us} * {width_us}").alias("ts_us"),
        "at",
        F.round(100 + F.col("value") / 100, 4).alias("price"),
        size.alias("size"),
    )
    return (
        rows.groupBy("symbol", "ts_us")
        .agg(
            F.min_by("price", "at").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "at").alias("close"),
            F.sum("size").alias("volume"),
            F.count("*").alias("trade_count"),
            F.sum(F.col("price") * F.col("size")).alias("_worth"),
        )
        .withColumn("vwap", F.when(F.col("volume") > 0, F.col("_worth") / F.col("volume")).otherwise(0.0))
        .drop("_worth")
    )


# Day-granular tape over line items: a unit is a day, a macro bar thirty days, a
# session one calendar year.
LINEITEM_PROFILE: Profile = replace(
    DEFAULT, unit_us=DAY_US, macro_us=30 * DAY_US, session_macros=13, gap_cap=900
)


def lineitem_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified prints: supplier = symbol, ship date = time, return flag = side."""
    li = table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1)
    return li.select(
        F.col("l_suppkey").alias("symbol"),
        F.year("l_shipdate").cast("bigint").alias("session"),
        ntz_us(F.col("l_shipdate")).alias("ts_us"),
        # a fixed order inside a day: a hash of every column of the line
        F.xxhash64(*li.columns).alias("seq"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("price"),
        F.col("l_quantity").cast("bigint").alias("size"),
        side.otherwise(0).alias("side"),
        F.lit(True).alias("updates_last"),
        F.lit(True).alias("updates_volume"),
        F.lit(True).alias("flow_eligible"),
        F.lit(0).cast("bigint").alias("open_us"),
        F.lit(0).cast("bigint").alias("close_us"),
    )
