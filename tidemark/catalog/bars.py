"""Bars, sessions, baselines, rolling values and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import floor_us, r
from ..functions.scan import Running, running
from ..functions.timefn import ntz_us
from ..operators import bars as B
from ..operators import context as ctx
from ..operators import ingest as I
from ..operators import metrics
from ..operators import session as S
from ..plans.pipeline import Tape
from ..operators import snapshot as snap
from ..sources import views as V
from .base import P, cte, query, tape

cte("micro", "sided", """
SELECT symbol, session, b_us, open, greatest(open, hi) AS high, least(open, lo) AS low,
  coalesce(lp, open) AS close, vol, buy_vol, sell_vol, n, dollar, s_pv, s_v, s_hi, s_lo,
  last_forming_us, open_us, close_us, false AS filled
FROM (SELECT *, CASE WHEN first_ul THEN first_price ELSE coalesce(last_value(lp IGNORE NULLS)
    OVER (PARTITION BY symbol, session ORDER BY b_us
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_price) END AS open
  FROM (SELECT symbol, session, ts_us // $U * $U AS b_us,
      arg_min(ul, ts_us) AS first_ul, arg_min(price, ts_us) AS first_price,
      max(price) FILTER (ul) AS hi, min(price) FILTER (ul) AS lo,
      arg_max(price, ts_us) FILTER (ul) AS lp, max(ts_us) FILTER (ul) AS last_forming_us,
      CAST(sum(size) AS BIGINT) AS vol,
      CAST(coalesce(sum(size) FILTER (side > 0), 0) AS BIGINT) AS buy_vol,
      CAST(coalesce(sum(size) FILTER (side < 0), 0) AS BIGINT) AS sell_vol,
      count(*) FILTER (fl) AS n, coalesce(sum(price * size) FILTER (fl), 0.0) AS dollar,
      coalesce(sum(price * size) FILTER (fl AND ts_us >= open_us), 0.0) AS s_pv,
      CAST(coalesce(sum(size) FILTER (fl AND ts_us >= open_us), 0) AS BIGINT) AS s_v,
      max(price) FILTER (ul AND ts_us >= open_us) AS s_hi,
      min(price) FILTER (ul AND ts_us >= open_us) AS s_lo,
      min(open_us) AS open_us, min(close_us) AS close_us
    FROM sided GROUP BY ALL))""")
cte("filled", "micro", """
SELECT * FROM micro UNION ALL
SELECT symbol, session, unnest(generate_series(CASE WHEN nb - b_us > 12 * $U THEN nb - $U
    ELSE b_us + $U END, nb - $U, $U)), close, close, close, close, 0, 0, 0, 0, 0.0, 0.0, 0,
  NULL, NULL, NULL, open_us, close_us, true
FROM (SELECT *, lead(b_us) OVER (PARTITION BY symbol, session ORDER BY b_us) AS nb FROM micro)
WHERE nb > b_us + $U""")
cte("macro", "filled", """
SELECT symbol, session, b_us // $M * $M AS m_us, arg_min(open, b_us) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, b_us) AS close, CAST(sum(vol) AS BIGINT) AS vol,
  CAST(sum(buy_vol) AS BIGINT) AS buy_vol, CAST(sum(sell_vol) AS BIGINT) AS sell_vol,
  CAST(sum(n) AS BIGINT) AS n, sum(dollar) AS dollar, count(*) FILTER (NOT filled) AS traded_units,
  min(open_us) AS open_us, min(close_us) AS close_us, b_us // $M * $M + $VIS AS eff_us
FROM filled GROUP BY ALL""")

BAR_COLS = "symbol, session, b_us, open, high, low, close, vol, buy_vol, sell_vol, n"


def bar_cols(df):
    return df.select(*BAR_COLS.split(", "), r(F.col("dollar"), 4).alias("dollar"))


@query("micro_bars", "micro", f"SELECT {BAR_COLS}, round(dollar, 4) AS dollar FROM micro")
def micro_bars(spark, sf_dir):
    return bar_cols(tape(spark, sf_dir).micro)


@query("rebucket_late", "trades", """
SELECT seq, ts_us, max(ts_us // $U * $U) OVER (PARTITION BY symbol, session ORDER BY arr_us, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b_us FROM trades""")
def rebucket_late(spark, sf_dir):
    return I.rebucket_late(I.clean(V.events_prints(spark, sf_dir)), P).select("seq", "ts_us", "b_us")


@query("late_bars", "trades", """
SELECT symbol, session, b_us, CASE WHEN ul0 THEN p0 ELSE coalesce(last_value(lp IGNORE NULLS) OVER w, p0) END AS open,
  coalesce(lp, CASE WHEN ul0 THEN p0 ELSE coalesce(last_value(lp IGNORE NULLS) OVER w, p0) END) AS close, vol, n
FROM (SELECT symbol, session, b_us, first(price ORDER BY arr_us, seq) AS p0, first(ul AND NOT late ORDER BY arr_us, seq) AS ul0,
    last(price ORDER BY arr_us, seq) FILTER (ul AND NOT late) AS lp, CAST(sum(size) AS BIGINT) AS vol,
    count(*) FILTER (fl AND NOT late) AS n
  FROM (SELECT *, coalesce(ts_us < max(ts_us) OVER (PARTITION BY symbol ORDER BY arr_us, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 6 * $U, false) AS late,
      max(ts_us // $U * $U) OVER (PARTITION BY symbol, session ORDER BY arr_us, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b_us FROM trades) GROUP BY ALL)
WINDOW w AS (PARTITION BY symbol, session ORDER BY b_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def late_bars(spark, sf_dir):
    """Bars of the tape as it arrived."""
    t = Tape(V.events_prints(spark, sf_dir), V.events_quotes(spark, sf_dir), V.events_sessions(spark, sf_dir), P, cut=False, late=True)
    return t.micro.select("symbol", "session", "b_us", "open", "close", "vol", "n")


@query("gap_fill", "filled", f"SELECT {BAR_COLS}, round(dollar, 4) AS dollar, filled FROM filled")
def gap_fill(spark, sf_dir):
    df = tape(spark, sf_dir).filled
    return df.select(*BAR_COLS.split(", "), r(F.col("dollar"), 4).alias("dollar"), "filled")


@query("macro_bars", "macro", """
SELECT symbol, session, m_us, eff_us, open, high, low, close, vol, buy_vol, sell_vol, n,
  round(dollar, 4) AS dollar, traded_units FROM macro""")
def macro_bars(spark, sf_dir):
    return tape(spark, sf_dir).macro.select(
        "symbol", "session", "m_us", "eff_us", "open", "high", "low", "close", "vol", "buy_vol",
        "sell_vol", "n", r(F.col("dollar"), 4).alias("dollar"), "traded_units",
    )


# bar-level windows; $-free names: <measure><window>
def _sum(col: str, n: int) -> str:
    return (
        f"coalesce(sum({col}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND 1 PRECEDING), 0)"
        f" AS p_{col}{n}"
    )


cte("barwin", "filled", f"""
SELECT *, {", ".join(_sum(c, n) for n in (5, 15, 60) for c in ("vol", "buy_vol", "sell_vol", "n"))},
  coalesce(sum(dollar) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0.0) AS p_dollar5,
  lag(close, 5) OVER w AS ago5, lag(close, 15) OVER w AS ago15,
  max(high) OVER (w ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS p_hi15,
  min(low) OVER (w ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS p_lo15,
  coalesce(sum(s_pv) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS c_pv,
  coalesce(sum(s_v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_v,
  max(s_hi) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c_hi,
  min(s_lo) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c_lo
FROM filled WINDOW w AS (PARTITION BY symbol, session ORDER BY b_us)""")


def _run(agg: str, cond: str, alias: str, zero: str | None = "0") -> str:
    body = f"{agg} FILTER ({cond}) OVER r"
    return f"{body if zero is None else f'coalesce({body}, {zero})'} AS {alias}"


cte("printrun", "sided", f"""
SELECT *, ts_us // $U * $U AS b_us,
  {_run("sum(size)", "true", "q_vol")}, {_run("sum(size)", "side > 0", "q_buy_vol")},
  {_run("sum(size)", "side < 0", "q_sell_vol")}, {_run("count(*)", "fl", "q_n")},
  {_run("sum(price * size)", "fl", "q_dollar", "0.0")},
  {_run("sum(price * size)", "fl AND ts_us >= open_us", "q_pv", "0.0")},
  {_run("sum(size)", "fl AND ts_us >= open_us", "q_v")},
  {_run("max(price)", "ul", "q_hi", None)}, {_run("min(price)", "ul", "q_lo", None)},
  {_run("max(price)", "ul AND ts_us >= open_us", "q_shi", None)},
  {_run("min(price)", "ul AND ts_us >= open_us", "q_slo", None)}
FROM sided WINDOW r AS (PARTITION BY symbol, session, ts_us // $U * $U ORDER BY ts_us, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
_V = {"vol": "v", "buy_vol": "b", "sell_vol": "s", "n": "n"}
cte("flowwin", "printrun barwin", f"""
SELECT p.*, w.ago5, w.ago15,
  {", ".join(f"CAST(p_{c}{n} + q_{c} AS BIGINT) AS {_V[c]}{n}" for n in (5, 15, 60) for c in _V)},
  p_dollar5 + q_dollar AS dollar5,
  CASE WHEN c_v + q_v > 0 THEN (c_pv + q_pv) / (c_v + q_v) END AS vwap,
  greatest(c_hi, q_shi) AS session_high, least(c_lo, q_slo) AS session_low,
  CASE WHEN q_n > 0 THEN greatest(p_hi15, w.open, q_hi) ELSE p_hi15 END AS hi15,
  CASE WHEN q_n > 0 THEN least(p_lo15, w.open, q_lo) ELSE p_lo15 END AS lo15
FROM printrun p JOIN barwin w USING (symbol, session, b_us)""")

FLOW_COLS = [f"{m}{n}" for n in (5, 15, 60) for m in ("v", "b", "s", "n")]


@query("rolling_flow", "flowwin", f"""
SELECT seq, {", ".join(FLOW_COLS)}, round(dollar5, 4) AS dollar5 FROM flowwin""")
def rolling_flow(spark, sf_dir):
    f = tape(spark, sf_dir).flow
    return f.select("seq", *FLOW_COLS, r(F.col("dollar5"), 4).alias("dollar5"))


@query("rolling_range", "flowwin", "SELECT seq, hi15, lo15 FROM flowwin")
def rolling_range(spark, sf_dir):
    return tape(spark, sf_dir).flow.select("seq", "hi15", "lo15")


@query("price_ago", "flowwin", "SELECT seq, price, ago5, ago15 FROM flowwin")
def price_ago(spark, sf_dir):
    return tape(spark, sf_dir).flow.select("seq", "price", "ago5", "ago15")


@query("session_vwap", "flowwin", "SELECT seq, round(vwap, 6) AS vwap FROM flowwin")
def session_vwap(spark, sf_dir):
    return tape(spark, sf_dir).flow.select("seq", r(F.col("vwap")).alias("vwap"))


@query("session_extremes", "flowwin", "SELECT seq, session_high, session_low FROM flowwin")
def session_extremes(spark, sf_dir):
    return tape(spark, sf_dir).flow.select("seq", "session_high", "session_low")


cte("opening", "sided", """
SELECT symbol, session, max(price) AS or_high, min(price) AS or_low,
  min(open_us) + 3 * $M AS or_eff_us
FROM sided WHERE ul AND ts_us >= open_us AND ts_us < open_us + 3 * $M GROUP BY ALL""")


@query("opening_range", "opening", "SELECT * FROM opening")
def opening_range(spark, sf_dir):
    return tape(spark, sf_dir).opening


cte("premarket", "filled", """
SELECT symbol, session, max(high) AS pmh, min(low) AS pml, arg_max(close, b_us) AS pm_close
FROM filled WHERE b_us >= open_us - 4 * 3600000000::BIGINT AND b_us < open_us GROUP BY ALL""")
cte("daily", "micro", """
SELECT symbol, session, max(high) AS high, min(low) AS low, arg_max(close, b_us) AS close,
  min(open_us) AS open_us FROM micro GROUP BY ALL""")
cte("prior", "daily", """
SELECT d.symbol, d.session, arg_max(q.high, q.session) AS pdh, arg_max(q.low, q.session) AS pdl,
  arg_max(q.close, q.session) AS pdc
FROM daily d LEFT JOIN daily q
  ON d.symbol = q.symbol AND q.session * $D < d.open_us - 10 * 3600000000::BIGINT
GROUP BY ALL""")


@query("premarket_levels", "premarket", "SELECT * FROM premarket")
def premarket_levels(spark, sf_dir):
    return S.premarket_levels(tape(spark, sf_dir).filled, P)


@query("prior_day_levels", "prior", "SELECT * FROM prior")
def prior_day_levels(spark, sf_dir):
    return S.prior_day_levels(S.daily_bars(tape(spark, sf_dir).micro), P)


@query("preopen_seed", "micro premarket", """
SELECT m.symbol, m.session, unnest(generate_series(m.open_us - 24 * $U, m.open_us - $U, $U)) AS b_us,
  p.pm_close AS close, 0::BIGINT AS vol
FROM (SELECT DISTINCT symbol, session, open_us FROM micro) m
JOIN premarket p ON m.symbol = p.symbol AND m.session = p.session + 1""")
def preopen_seed(spark, sf_dir):
    t = tape(spark, sf_dir)
    # bars of the session proper; yesterday's premarket close plays the last known price
    keys = t.micro.select("symbol", "session", "open_us", "close_us").distinct()
    last = S.premarket_levels(t.filled, P).select(
        "symbol", (F.col("session") + 1).alias("session"), F.col("pm_close").alias("price")
    )
    late = t.micro.filter(F.col("b_us") >= F.col("open_us"))
    seeds = B.preopen_seed(late, last.join(keys, ["symbol", "session"]), P, 24)
    return seeds.select("symbol", "session", "b_us", "close", "vol")


cte("ema", "macro", """
SELECT *, round(ema20 - lag(ema20, 3) OVER (PARTITION BY symbol, session ORDER BY m_us), 9) AS ema_change
FROM (SELECT *, list_reduce(list(close) OVER (PARTITION BY symbol, session ORDER BY m_us
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    lambda a, x: x * (2.0::DOUBLE / 21) + a * (1 - 2.0::DOUBLE / 21)) AS ema20 FROM macro)""")


@query("ema20", "ema", "SELECT symbol, session, m_us, round(ema20, 6) AS ema20 FROM ema")
def ema20(spark, sf_dir):
    out = B.with_ema(tape(spark, sf_dir).macro)
    return out.select("symbol", "session", "m_us", r(F.col("ema20")).alias("ema20"))


@query("ema_slope", "ema", """
SELECT symbol, session, m_us, round(ema_change / close * 1e4, 6) AS ema_slope FROM ema""")
def ema_slope(spark, sf_dir):
    out = B.with_ema_slope(tape(spark, sf_dir).macro)
    return out.select("symbol", "session", "m_us", r(F.col("ema_slope")).alias("ema_slope"))


@query("hist_to_minutes", "", """
SELECT o_custkey AS symbol, epoch_us(o_orderdate) // $M * $M AS m_us, o_totalprice AS close,
  o_orderkey % 1000 AS vol, round((CASE WHEN o_orderstatus = 'P' THEN o_totalprice
    ELSE o_totalprice + 1 END) * (o_orderkey % 1000), 4) AS dollar FROM orders""")
def hist_to_minutes(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    hist = o.select(
        F.col("o_custkey").alias("symbol"), ntz_us(F.col("o_orderdate")).alias("ts_us"),
        price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"),
        (F.col("o_orderkey") % 1000).alias("volume"), F.lit(1).alias("trade_count"),
        F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(price + 1).alias("vwap"),
    )
    out = B.hist_to_minutes(hist, P)
    return out.select("symbol", "m_us", "close", "vol", r(F.col("dollar"), 4).alias("dollar"))


@query("minute_idx", "sided", """
SELECT seq, (ts_us - open_us - ((ts_us - open_us) % $M + $M) % $M) // $M AS idx,
  round(greatest(0.0, least(1.0, ((ts_us - open_us - ((ts_us - open_us) % $M + $M) % $M) // $M)
    / 40.0::DOUBLE)), 6) AS minute_frac FROM sided""")
def minute_idx(spark, sf_dir):
    return tape(spark, sf_dir).flow.select("seq", "idx", r(F.col("minute_frac")).alias("minute_frac"))


# ------------------------------------------------------------------ calendar and baselines


cte("days", "", "SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5")


@query("calendar", "days", """
SELECT strftime(d, '%Y-%m-%d') AS date, CAST(d - DATE '1970-01-01' AS BIGINT) AS session,
  epoch_us(timezone('America/New_York', d + INTERVAL '9 hours 30 minutes')) AS open_us,
  epoch_us(timezone('America/New_York', d + CASE WHEN dayofweek(d) = 5 THEN INTERVAL 13 HOUR
    ELSE INTERVAL 16 HOUR END)) AS close_us,
  CAST(CASE WHEN dayofweek(d) = 5 THEN 210 ELSE 390 END AS BIGINT) AS minutes FROM days""")
def calendar(spark, sf_dir):
    """Trading days of the order book: weekends absent, early close on Fridays."""
    day = F.col("o_orderdate").cast("date")
    raw = (
        V.table(spark, sf_dir, "orders")
        .filter(F.dayofweek("o_orderdate").between(2, 6))
        .select(
            day.cast("string").alias("date"),
            F.lit("09:30").alias("open"),
            F.when(F.dayofweek("o_orderdate") == 6, "13:00").otherwise("16:00").alias("close"),
        )
        .distinct()
    )
    return S.calendar(raw)


cte("sessions", "ticks", """
SELECT session, min(open_us) AS open_us, min(close_us) AS close_us,
  row_number() OVER (ORDER BY session) AS i FROM ticks GROUP BY session""")
cte("look", "sessions", """
SELECT a.session, b.session AS prior_session, a.i - b.i AS age FROM sessions a JOIN sessions b
  ON a.i - b.i BETWEEN 1 AND 5""")


@query("completed_sessions", "look", "SELECT session, prior_session, age FROM look")
def completed_sessions(spark, sf_dir):
    return S.completed_before(V.events_sessions(spark, sf_dir), P.baseline_sessions)


@query("bars_in_session", "micro", """
SELECT symbol, session, b_us, vol FROM micro WHERE b_us >= open_us AND b_us < close_us""")
def bars_in_session(spark, sf_dir):
    bars = tape(spark, sf_dir).micro.select(
        "symbol", "session", "b_us", "vol", F.col("b_us").alias("ts_us")
    )
    rows = S.rows_in_session(bars, V.events_sessions(spark, sf_dir), "UTC")
    return rows.select("symbol", "session", "b_us", "vol")


cte("baseline", "macro look", """
SELECT m.symbol, l.session, (m.m_us - m.open_us) // $M AS idx, median(m.vol::DOUBLE) AS vol_med,
  median(m.n::DOUBLE) AS n_med
FROM macro m JOIN look l ON m.session = l.prior_session
WHERE m.traded_units > 0 AND m.m_us >= m.open_us AND m.m_us < m.close_us GROUP BY ALL""")
cte("fallback", "baseline", """
SELECT symbol, session, coalesce(median(vol_med) FILTER (vol_med > 0), 0.0) AS vol_fallback,
  coalesce(median(n_med) FILTER (n_med > 0), 0.0) AS n_fallback,
  coalesce(median(vol_med) FILTER (vol_med > 0), 0.0) > 0 AS ready,
  coalesce(median(vol_med) FILTER (vol_med > 0 AND idx >= 8 AND idx < 32),
    median(vol_med) FILTER (vol_med > 0), 0.0) / 0.6::DOUBLE AS midday5
FROM baseline GROUP BY ALL""")


@query("minute_baseline", "baseline", "SELECT * FROM baseline")
def minute_baseline(spark, sf_dir):
    return tape(spark, sf_dir).baseline


@query("baseline_fallback", "fallback", """
SELECT symbol, session, vol_fallback, n_fallback, ready FROM fallback""")
def baseline_fallback(spark, sf_dir):
    return tape(spark, sf_dir).fallback.drop("midday5")


@query("midday_ruler", "fallback", "SELECT symbol, session, round(midday5, 6) AS midday5 FROM fallback")
def midday_ruler(spark, sf_dir):
    out = tape(spark, sf_dir).fallback
    return out.select("symbol", "session", r(F.col("midday5")).alias("midday5"))


cte("looked", "filled baseline fallback", """
SELECT f.symbol, f.session, f.b_us,
  coalesce(CASE WHEN b.vol_med > 0 THEN b.vol_med END, k.vol_fallback, 0.0) AS base_vol,
  coalesce(CASE WHEN b.n_med > 0 THEN b.n_med END, k.n_fallback, 0.0) AS base_n,
  coalesce(k.midday5, 0.0) AS midday5
FROM filled f LEFT JOIN baseline b ON f.symbol = b.symbol AND f.session = b.session
  AND f.b_us >= f.open_us AND (f.b_us - f.open_us) // $M = b.idx
LEFT JOIN fallback k ON f.symbol = k.symbol AND f.session = k.session""")


@query("baseline_lookup", "looked", """
SELECT symbol, session, b_us, base_vol, base_n FROM looked""")
def baseline_lookup(spark, sf_dir):
    return tape(spark, sf_dir).bar_state.select("symbol", "session", "b_us", "base_vol", "base_n")


@query("tod_bucket", "sided", """
SELECT seq, CASE WHEN ts_us < open_us + 3600000000 THEN 0 WHEN ts_us > close_us - 3600000000 THEN 2
  ELSE 1 END AS bucket FROM sided""")
def tod_bucket(spark, sf_dir):
    c = F.col
    return tape(spark, sf_dir).sided.select(
        "seq", metrics.tod_bucket(c("ts_us"), c("open_us"), c("close_us")).alias("bucket")
    )


# ------------------------------------------------------------------ market context


def _vel(k: int) -> str:
    ago = f"lag(close, {k - 1}) OVER w"
    return (
        f"coalesce(greatest(-200.0, least(200.0, (close - {ago}) / {ago} * 1e4 / {k})), 0.0)"
    )


cte("proxy", "filled", f"""
SELECT symbol, session, b_us + $U AS eff_us, {_vel(6)} AS v_short, {_vel(18)} AS v_long,
  max(last_forming_us) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen_us
FROM filled WHERE symbol IN ('view', 'error')
WINDOW w AS (PARTITION BY symbol, session ORDER BY b_us)""")
cte("context", "filled proxy", """
SELECT g.session, g.b_us,
  CASE WHEN g.b_us - m.seen_us <= 12 * $U THEN m.v_short ELSE 0.0 END AS mkt_1m,
  CASE WHEN g.b_us - m.seen_us <= 12 * $U THEN m.v_long ELSE 0.0 END AS mkt_5m,
  CASE WHEN g.b_us - f.seen_us <= 12 * $U THEN f.v_short ELSE 0.0 END AS fear_1m,
  CASE WHEN g.b_us - f.seen_us <= 12 * $U THEN f.v_long ELSE 0.0 END AS fear_5m
FROM (SELECT DISTINCT session, b_us FROM filled) g
ASOF LEFT JOIN (SELECT * FROM proxy WHERE symbol = 'view') m
  ON g.session = m.session AND g.b_us >= m.eff_us
ASOF LEFT JOIN (SELECT * FROM proxy WHERE symbol = 'error') f
  ON g.session = f.session AND g.b_us >= f.eff_us""")


@query("context_velocity", "proxy", """
SELECT symbol, session, eff_us, round(v_short, 6) AS v_short, round(v_long, 6) AS v_long
FROM proxy""")
def context_velocity(spark, sf_dir):
    filled = tape(spark, sf_dir).filled
    parts = [
        ctx.proxy_velocity(filled, s, P).select(
            F.lit(s).alias("symbol"), "session", "eff_us", r(F.col("v_short")).alias("v_short"),
            r(F.col("v_long")).alias("v_long"),
        )
        for s in (V.MARKET, V.FEAR)
    ]
    return parts[0].unionByName(parts[1])


@query("context_features", "context", """
SELECT session, b_us, round(mkt_1m, 6) AS mkt_1m, round(mkt_5m, 6) AS mkt_5m,
  round(fear_1m, 6) AS fear_1m, round(fear_5m, 6) AS fear_5m FROM context""")
def context_features(spark, sf_dir):
    rows = tape(spark, sf_dir).bar_state
    cols = ("mkt_1m", "mkt_5m", "fear_1m", "fear_5m")
    one = rows.groupBy("session", "b_us").agg(*[F.first(c).alias(c) for c in cols])
    return one.select("session", "b_us", *[r(F.col(c)).alias(c) for c in cols])


@query("price_at", "macro sided", """
SELECT s.seq, m.close AS minute_close FROM sided s ASOF LEFT JOIN
  (SELECT *, m_us + $M - $U AS known_us FROM macro) m
  ON s.symbol = m.symbol AND s.session = m.session AND s.ts_us >= m.known_us""")
def price_at(spark, sf_dir):
    """Close of the last macro bar ending no later than one unit after the instant."""
    t = tape(spark, sf_dir)
    c = F.col
    rows = t.sided.select("symbol", "session", "ts_us", "seq", F.lit(1).alias("_prio"))
    bars = t.macro.select(
        "symbol", "session", (c("m_us") + P.macro_us - P.unit_us).alias("ts_us"),
        F.lit(0).alias("_prio"), F.struct("close").alias("_bar"),
    )
    both = rows.unionByName(bars, allowMissingColumns=True).withColumn(
        "_chunk", floor_us(c("ts_us"), P.macro_us)
    )
    last = Running("last", "last", c("_bar"))
    seen = running(both, ["symbol", "session"], "_chunk", ["ts_us", "_prio", "seq"], [last])
    return seen.filter("_prio = 1").select("seq", c("last.close").alias("minute_close"))


# ------------------------------------------------------------------ flow features of a print

FEATS = ("vel5", "vel15", "vol_ratio_prev", "vol_ratio_base", "imb5", "imb15", "buy_share5",
         "n_ratio_prev", "range_exp", "dist_vwap_bps", "spread_bps", "quote_imb")


def _feature_query(name: str, cols: tuple[str, ...]) -> None:
    listed = ", ".join(f"round({c}, 6) AS {c}" for c in cols)

    @query(name, "features0", f"SELECT seq, {listed} FROM features0")
    def run(spark, sf_dir):
        return tape(spark, sf_dir).flow.select("seq", *[r(F.col(c)).alias(c) for c in cols])


cte("macro_state0", "macro", """
SELECT *, row_number() OVER w AS epoch,
  CASE WHEN count(*) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 5
    THEN avg(high - low) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS avg_range5
FROM macro WINDOW w AS (PARTITION BY symbol, session ORDER BY m_us)""")
cte("features0", "flowwin looked macro_state0", """
SELECT f.*, idx, greatest(0.0, least(1.0, idx / 40.0::DOUBLE)) AS minute_frac, base_vol,
  coalesce((price - ago5) / ago5 * 1e4 / 5, 0.0) AS vel5,
  coalesce((price - ago15) / ago15 * 1e4 / 15, 0.0) AS vel15,
  CASE WHEN idx < 2 AND midday5 > 0 THEN v5 / midday5
    WHEN (v60 - v5) / 11.0::DOUBLE > 1e-9 THEN v5 / ((v60 - v5) / 11.0::DOUBLE)
    WHEN v5 > 0 THEN 20.0 ELSE 0.0 END AS vol_ratio_prev,
  CASE WHEN idx < 2 OR base_vol <= 0 THEN 0.0 ELSE v5 / (base_vol / 0.6::DOUBLE) END
    AS vol_ratio_base,
  CASE WHEN b5 + s5 > 0 THEN (b5 - s5) / (b5 + s5)::DOUBLE ELSE 0.0 END AS imb5,
  CASE WHEN b15 + s15 > 0 THEN (b15 - s15) / (b15 + s15)::DOUBLE ELSE 0.0 END AS imb15,
  CASE WHEN b5 + s5 > 0 THEN b5 / (b5 + s5)::DOUBLE ELSE 0.5 END AS buy_share5,
  CASE WHEN (n60 - n5) / 11.0::DOUBLE > 1e-9 THEN n5 / ((n60 - n5) / 11.0::DOUBLE)
    WHEN n5 > 0 THEN 20.0 ELSE 0.0 END AS n_ratio_prev,
  CASE WHEN avg_range5 > 0 THEN coalesce((hi15 - lo15) / price * 1e4, 0.0)
    / (avg_range5 / price * 1e4 / 2) ELSE 1.0 END AS range_exp,
  coalesce((price - vwap) / vwap * 1e4, 0.0) AS dist_vwap_bps,
  coalesce((ask - bid) / bid * 1e4, 0.0) AS spread_bps,
  CASE WHEN bid_size + ask_size > 0 THEN (bid_size - ask_size) / (bid_size + ask_size)::DOUBLE
    ELSE 0.0 END AS quote_imb
FROM (SELECT *, (ts_us - open_us - ((ts_us - open_us) % $M + $M) % $M) // $M AS idx FROM flowwin) f
JOIN looked USING (symbol, session, b_us)
ASOF LEFT JOIN (SELECT symbol, session, eff_us, avg_range5 FROM macro_state0) m
  ON f.symbol = m.symbol AND f.session = m.session AND f.b_us >= m.eff_us""")

_feature_query("velocity", ("vel5", "vel15"))
_feature_query("vol_ratio_prev", ("vol_ratio_prev",))
_feature_query("vol_ratio_base", ("vol_ratio_base",))
_feature_query("imbalance", ("imb5", "imb15", "buy_share5"))
_feature_query("n_ratio", ("n_ratio_prev",))
_feature_query("range_exp", ("range_exp",))
_feature_query("quote_features", ("dist_vwap_bps", "spread_bps", "quote_imb"))


def _near(agg: str, cond: str, units: str) -> str:
    # 1500 and 1200 seconds: two and a half and two units
    return (
        f"{agg} FILTER ({cond}) OVER (PARTITION BY symbol, session ORDER BY ts_us "
        f"RANGE BETWEEN {units} PRECEDING AND CURRENT ROW)"
    )


def _side_cols(tag: str, sign: int) -> str:
    w, own = "1500000000", f"fl AND side = {sign}"
    return f"""{_near("count(*)", own, w)} AS persist_{tag},
  CASE WHEN {_near("count(*)", own, w)} >= 2 THEN ({_near("max(ts_us)", own, w)}
    - {_near("min(ts_us)", own, w)}) / $U::DOUBLE ELSE 0.0 END AS span_{tag},
  coalesce({_near("max(size)", own, w)} / {_near("sum(size)", own, w)}::DOUBLE, 1.0) AS dom_{tag}"""


cte("persist", "sided", f"""
SELECT *, {_near("count(*)", "fl", "1200000000")} AS n2s, {_side_cols("up", 1)},
  {_side_cols("dn", -1)} FROM sided""")


@query("persistence", "persist", """
SELECT seq, n2s, persist_up, persist_dn, round(span_up, 6) AS span_up,
  round(span_dn, 6) AS span_dn, round(dom_up, 6) AS dom_up, round(dom_dn, 6) AS dom_dn
FROM persist""")
def persistence(spark, sf_dir):
    out = snap.with_persistence(tape(spark, sf_dir).sided, P)
    num = ("span_up", "span_dn", "dom_up", "dom_dn")
    return out.select("seq", "n2s", "persist_up", "persist_dn", *[r(F.col(c)).alias(c) for c in num])


@query("flow_leaders", "flowwin", """
SELECT symbol, session, b_us, v15, round(imb15, 6) AS imb15 FROM (
  SELECT symbol, session, b_us, v15, (b15 - s15) / (b15 + s15)::DOUBLE AS imb15,
    row_number() OVER (PARTITION BY symbol, session, b_us ORDER BY ts_us DESC, seq DESC) AS i
  FROM flowwin WHERE b15 + s15 > 0)
WHERE i = 1 ORDER BY abs(round(imb15, 6)) DESC, v15 DESC, symbol, b_us LIMIT 100""")
def flow_leaders(spark, sf_dir):
    """Flagship: the hundred buckets with the strongest one-sided flow."""
    t = tape(spark, sf_dir)
    rows = B.print_windows(t.sided, B.with_bar_windows(t.filled, (15,), (), ()), P, (15,))
    c = F.col
    last = (
        rows.filter(c("b15") + c("s15") > 0)
        .groupBy("symbol", "session", "b_us")
        .agg(F.max_by(F.struct("v15", "b15", "s15"), F.struct("ts_us", "seq")).alias("x"))
        .select("symbol", "session", "b_us", "x.*")
    )
    imb = r((c("b15") - c("s15")) / (c("b15") + c("s15")))
    out = last.select("symbol", "session", "b_us", "v15", imb.alias("imb15"))
    return out.orderBy(F.abs(c("imb15")).desc(), c("v15").desc(), "symbol", "b_us").limit(100)
