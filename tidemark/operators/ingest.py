"""Cleaning of the raw tape: condition codes, bad fields, late prints, feed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.expr import floor_us
from ..functions.scan import Running, ewma, running
from ..profile import Profile

# Sale-condition codes and what they may update.
ADMIN_CODES = ("M", "Q", "9")  # official open/close, corrections: not prints at all
ODD_LOT_CODES = ("I",)  # volume and flow, not price
AVERAGE_CODES = ("W", "4", "7")  # average price, derivative: volume only
OFF_MARKET_CODES = ("T", "U", "Z", "L", "P", "R", "C", "H", "G", "N", "V")  # volume only


def _any(conditions: Column, codes) -> Column:
    wanted = F.array(*[F.lit(c) for c in codes])
    return F.coalesce(F.arrays_overlap(conditions, wanted), F.lit(False))


def with_condition_flags(prints: DataFrame) -> DataFrame:
    """Add ``admin``, ``updates_last``, ``updates_volume`` and ``flow_eligible``."""
    c = F.col("conditions")
    volume_only = _any(c, AVERAGE_CODES) | _any(c, OFF_MARKET_CODES)
    return (
        prints.withColumn("admin", _any(c, ADMIN_CODES))
        .withColumn("updates_last", ~(volume_only | _any(c, ODD_LOT_CODES)))
        .withColumn("updates_volume", F.lit(True))
        .withColumn("flow_eligible", ~volume_only)
    )


def drop_bad(prints: DataFrame) -> DataFrame:
    return prints.filter((F.col("price") > 0) & (F.col("size") > 0))


def clean(prints: DataFrame) -> DataFrame:
    """Usable prints with their flags; administrative and broken rows are gone."""
    return drop_bad(with_condition_flags(prints)).filter(~F.col("admin")).drop("admin")


def late_demote(prints: DataFrame, p: Profile) -> DataFrame:
    """Prints older than the symbol's watermark minus grace keep only their volume.

    Arrival order is (arr_us, seq); the watermark is the running maximum event time."""
    chunked = prints.withColumn("_chunk", floor_us(F.col("arr_us"), p.macro_us))
    seen = running(
        chunked,
        ["symbol"],
        "_chunk",
        ["arr_us", "seq"],
        [Running("watermark_us", "max", F.col("ts_us"), inclusive=False)],
    )
    late = F.coalesce(F.col("ts_us") < F.col("watermark_us") - p.us(p.late_grace), F.lit(False))
    return (
        seen.withColumn("late", late)
        .withColumn("updates_last", F.col("updates_last") & ~late)
        .withColumn("flow_eligible", F.col("flow_eligible") & ~late)
        .drop("_chunk")
    )


def rebucket_late(prints: DataFrame, p: Profile, newest: DataFrame | None = None) -> DataFrame:
    """Bucket each print on arrival: a finalized bucket is never reopened.

    ``newest`` (symbol, session, b_us) are the buckets that earlier prints have reached."""
    rows = prints.withColumn("own_b_us", floor_us(F.col("ts_us"), p.unit_us)).withColumn(
        "_chunk", floor_us(F.col("arr_us"), p.macro_us)
    )
    return running(
        rows,
        ["symbol", "session"],
        "_chunk",
        ["arr_us", "seq"],
        [Running("b_us", "max", F.col("own_b_us"))],
        initial=newest,
    ).drop("_chunk")


def filter_stats(prints: DataFrame, p: Profile) -> DataFrame:
    """Per symbol: administrative, broken and late prints."""
    flagged = with_condition_flags(prints)
    bad = ~((F.col("price") > 0) & (F.col("size") > 0))
    drops = flagged.groupBy("symbol").agg(
        F.count_if(bad).alias("dropped_bad_fields"),
        F.count_if(~bad & F.col("admin")).alias("admin_excluded"),
        F.count("*").alias("prints"),
    )
    late = late_demote(clean(prints), p).groupBy("symbol").agg(
        F.count_if("late").alias("late_out_of_sequence")
    )
    return drops.join(late, "symbol", "left").select(
        "symbol",
        "prints",
        "dropped_bad_fields",
        "admin_excluded",
        F.coalesce("late_out_of_sequence", F.lit(0)).alias("late_out_of_sequence"),
    )


def order_violations(prints: DataFrame, p: Profile) -> DataFrame:
    """Rows more than ``replay_slack`` older than anything already replayed that session."""
    rows = prints.withColumn("_chunk", floor_us(F.col("arr_us"), p.macro_us))
    seen = running(
        rows,
        ["session"],
        "_chunk",
        ["arr_us", "seq"],
        [Running("max_seen_us", "max", F.col("ts_us"), inclusive=False)],
    )
    return seen.filter(F.col("ts_us") < F.col("max_seen_us") - p.us(p.replay_slack)).drop("_chunk")


def feed_gaps(live: DataFrame, p: Profile) -> DataFrame:
    """Silent stretches of the live feed: (session, gap_from_us, gap_to_us)."""
    rows = live.select("session", "ts_us", "seq").withColumn(
        "_chunk", floor_us(F.col("ts_us"), p.macro_us)
    )
    prev = running(
        rows,
        ["session"],
        "_chunk",
        ["ts_us", "seq"],
        [Running("gap_from_us", "max", F.col("ts_us"), inclusive=False)],
    )
    return prev.filter(F.col("ts_us") - F.col("gap_from_us") > p.us(p.backfill_gap)).select(
        "session", "gap_from_us", F.col("ts_us").alias("gap_to_us")
    )


def gap_backfill(live: DataFrame, history: DataFrame, p: Profile) -> DataFrame:
    """Live rows plus historical rows for the gaps; backfilled rows are flagged.

    A gap is spread over the macro buckets it touches, so the join is on equality.  Live rows
    stay as they are; a fetched row goes if the session has a live row with its symbol,
    exchange and trade id.  A missing id identifies nothing: such a row goes only if a live one
    without an id has its instant, price and size as well."""
    lo, hi = floor_us(F.col("gap_from_us"), p.macro_us), floor_us(F.col("gap_to_us"), p.macro_us)
    gaps = feed_gaps(live, p).select(
        F.col("session").alias("_gap_session"),
        "gap_from_us",
        "gap_to_us",
        F.explode(F.sequence(lo, hi, F.lit(p.macro_us))).alias("_gap_chunk"),
    )
    inside = (
        (F.col("session") == F.col("_gap_session"))
        & (floor_us(F.col("ts_us"), p.macro_us) == F.col("_gap_chunk"))
        & F.col("ts_us").between(F.col("gap_from_us"), F.col("gap_to_us"))
    )
    fetched = history.join(gaps, inside, "left_semi")
    keys = ["session", "symbol", "exchange", "trade_id"]
    exact = ["ts_us", "price", "size"]

    def without(rows: DataFrame, named: bool, columns: list[str]) -> DataFrame:
        has_id = F.col("trade_id").isNotNull() if named else F.col("trade_id").isNull()
        known = live.filter(has_id).select(*[F.col(k).alias(f"_{k}") for k in columns])
        same = F.lit(True)
        for k in columns:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return rows.filter(has_id).join(known, same, "left_anti")

    new = without(fetched, True, keys).unionByName(without(fetched, False, keys + exact))
    return live.withColumn("is_backfill", F.lit(False)).unionByName(new.withColumn("is_backfill", F.lit(True)))


def feed_health(prints: DataFrame, p: Profile) -> DataFrame:
    """Per unit of arrival time: latency average, silence, and whether alerts may go out."""
    per_unit = (
        prints.withColumn("b_us", floor_us(F.col("arr_us"), p.unit_us))
        .groupBy("session", "b_us")
        .agg(
            F.count("*").alias("prints"),
            F.sum(F.col("arr_us") - F.col("ts_us")).alias("_lag"),
            F.min("arr_us").alias("first_arr_us"),
            F.max("arr_us").alias("last_arr_us"),
        )
        .withColumn("lag_units", F.col("_lag") / F.col("prints") / p.unit_us)
        .drop("_lag")
    )
    smooth = ewma(per_unit, ["session"], "b_us", F.col("lag_units"), p.feed_alpha, "latency")
    w = W.partitionBy("session").orderBy("b_us")
    silence = (F.col("b_us") - F.lag("last_arr_us").over(w)) / p.unit_us
    return smooth.withColumn("silence", F.coalesce(silence, F.lit(0.0))).withColumn(
        "alerts_enabled",
        (F.col("latency") <= p.feed_latency_max) & (F.col("silence") <= p.feed_silence),
    )


def health_changes(prints: DataFrame, p: Profile) -> DataFrame:
    """(session, at_us, alerts_enabled, cause): the instants at which alerts are switched off or on.

    Before a session's first row they are on.  The latency average of a unit of arrival time counts
    from that unit's end.  Silence begins right after the longest allowed wait and ends with the next
    arrival, so there are rows inside it, also after the last arrival.  ``cause`` is ``latency``,
    ``silence`` (which goes first) or null.  A session has a few rows a unit at most, however many prints."""
    c, wait = F.col, p.us(p.feed_silence)
    units = feed_health(prints, p)
    w = W.partitionBy("session").orderBy("b_us")
    units = units.withColumn("_next", F.lead("first_arr_us").over(w))
    quiet = F.coalesce(c("_next") - c("last_arr_us") > wait, F.lit(True))
    none = F.lit(None).cast("boolean")
    events = F.array(
        F.struct((c("b_us") + p.unit_us).alias("at_us"), (c("latency") > p.feed_latency_max).alias("slow"), none.alias("silent")),
        F.when(quiet, F.struct((c("last_arr_us") + wait + 1).alias("at_us"), none.alias("slow"), F.lit(True).alias("silent"))),
        F.when(quiet & c("_next").isNotNull(), F.struct(c("_next").alias("at_us"), none.alias("slow"), F.lit(False).alias("silent"))),
    )
    rows = units.select("session", F.explode(F.array_compact(events)).alias("_e")).select("session", "_e.*")
    # an arrival at the very instant silence would begin ends it
    rows = rows.groupBy("session", "at_us").agg(F.max("slow").alias("slow"), F.min("silent").alias("silent"))
    upto = W.partitionBy("session").orderBy("at_us")
    slow, silent = (F.coalesce(F.last(x, ignorenulls=True).over(upto), F.lit(False)) for x in ("slow", "silent"))
    state = F.when(silent, "silence").when(slow, "latency")
    told = rows.select("session", "at_us", state.alias("cause"))
    changed = ~c("cause").eqNullSafe(F.lag("cause").over(upto))
    return told.withColumn("_new", changed).filter("_new").select(
        "session", "at_us", c("cause").isNull().alias("alerts_enabled"), "cause"
    )


def alertable(rows: DataFrame, changes: DataFrame, p: Profile, at: str = "arr_us") -> DataFrame:
    """Rows at whose instant ``at`` alerts were on (see :func:`health_changes`); a change counts from
    its own instant.  Rows without an instant have nothing that speaks against them.

    A chunked as-of scan: rows of a session meet its changes in time chunks, not in one task."""
    c = F.col
    marks = changes.select("session", c("at_us").alias("_at"), "alerts_enabled", F.lit(0).alias("_side"))
    both = rows.withColumns({"_at": c(at), "_side": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("_chunk", floor_us(c("_at"), p.macro_us))
    on = Running("_on", "last", F.when(c("_side") == 0, c("alerts_enabled")))
    seen = running(both, ["session"], "_chunk", ["_at", "_side"], [on])
    open_ = F.coalesce("_on", F.lit(True)) | c("_at").isNull()
    return seen.filter((c("_side") == 1) & open_).select(*rows.columns)


def merge_tape(trades: DataFrame, quotes: DataFrame, context: DataFrame) -> DataFrame:
    """One ordered event stream: trades, then quotes, then context prints at a tie.

    Order is carried by columns (ts_us, src_prio, seq); consumers sort inside their
    windows, so the union itself moves no data.  Context symbols that are scanned
    anyway are not repeated."""
    scanned = trades.select("symbol").distinct()
    extra = context.join(scanned, "symbol", "left_anti")
    cols = ["symbol", "session", "ts_us", "seq", "price", "size", "bid", "ask"]
    parts = [(trades, 0, "trade"), (quotes, 1, "quote"), (extra, 2, "context")]
    out = None
    for df, prio, name in parts:
        have = [c for c in cols if c in df.columns]
        one = df.select(*have, F.lit(prio).alias("src_prio"), F.lit(name).alias("src"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
