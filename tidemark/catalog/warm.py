"""The warmed-up tape: seeds from historical bars, and running state that goes on from them.

Averages are shown a little above themselves, so that exact ties round one way whatever the
order of a sum was."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r
from ..operators import bars as B
from ..operators import session as S
from ..operators import warmup
from ..sources import views as V
from .base import CTES, P, cte, query, warm_tape

K = ["symbol", "session"]

cte("starts", "ticks", f"""
SELECT session, min(open_us) + (CASE session % 3 WHEN 0 THEN {V.START_MACROS[0]} WHEN 1 THEN {V.START_MACROS[1]}
  ELSE {V.START_MACROS[2]} END) * $M AS start_us FROM ticks GROUP BY session""")
cte("hist", "ticks starts", """
SELECT *, CASE WHEN vwap > 0 THEN vwap ELSE close END * vol AS dollar FROM (
  SELECT symbol, session, ts_us // $M * $M AS m_us, min(open_us) AS open_us, min(close_us) AS close_us,
    arg_min(price, ts_us) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts_us) AS close,
    CAST(sum(size) AS BIGINT) AS vol, count(*) AS n,
    CASE WHEN sum(size) > 0 THEN sum(price * size) / sum(size) ELSE 0.0 END AS vwap
  FROM ticks WHERE price > 0 GROUP BY ALL)
JOIN starts USING (session) WHERE m_us + $M <= start_us""")
cte("histday", "ticks", """
SELECT symbol, session, max(price) AS high, min(price) AS low, arg_max(price, ts_us) AS close
FROM ticks WHERE price > 0 GROUP BY ALL""")
cte("ownhist", "hist", "SELECT * FROM hist WHERE m_us >= open_us AND start_us > open_us + $M")
cte("pmhist", "hist", "SELECT * FROM hist WHERE m_us >= open_us - 4 * 3600000000::BIGINT AND m_us < open_us")
cte("pmema", "pmhist", """
SELECT *, list_reduce(list(close) OVER (PARTITION BY symbol, session ORDER BY m_us
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    lambda a, x: x * (2.0::DOUBLE / 21) + a * (1 - 2.0::DOUBLE / 21)) AS ema FROM pmhist""")
cte("wseeds", "ownhist pmhist pmema starts", """
SELECT k.symbol, k.session, pmh, pml, pm_close, seed_pv, seed_v, seed_hi, seed_lo, or_high, or_low, ema,
  own_close IS NULL AND pm_close IS NOT NULL AND start_us <= coalesce(p.open_us, o.open_us) + $M AS preopen,
  coalesce(own_close, CASE WHEN start_us <= coalesce(p.open_us, o.open_us) + $M THEN pm_close END) AS last_price,
  coalesce(p.open_us, o.open_us) AS open_us, coalesce(p.close_us, o.close_us) AS close_us
FROM (SELECT symbol, session FROM ownhist UNION SELECT symbol, session FROM pmhist) k
JOIN starts USING (session)
LEFT JOIN (SELECT symbol, session, max(high) AS pmh, min(low) AS pml, arg_max(close, m_us) AS pm_close,
  min(open_us) AS open_us, min(close_us) AS close_us FROM pmhist GROUP BY ALL) p
  ON k.symbol = p.symbol AND k.session = p.session
LEFT JOIN (SELECT symbol, session, sum(dollar) AS seed_pv, CAST(sum(vol) AS BIGINT) AS seed_v, max(high) AS seed_hi,
    min(low) AS seed_lo, arg_max(close, m_us) AS own_close, min(open_us) AS open_us, min(close_us) AS close_us,
    max(high) FILTER (m_us < open_us + 3 * $M AND start_us >= open_us + 3 * $M) AS or_high,
    min(low) FILTER (m_us < open_us + 3 * $M AND start_us >= open_us + 3 * $M) AS or_low
  FROM ownhist GROUP BY ALL) o ON k.symbol = o.symbol AND k.session = o.session
LEFT JOIN (SELECT symbol, session, arg_max(ema, m_us) AS ema FROM pmema GROUP BY ALL) e
  ON k.symbol = e.symbol AND k.session = e.session""")


@query("warmup_seeds", "wseeds histday", """
SELECT s.symbol, s.session, d.high AS pdh, d.low AS pdl, d.close AS pdc, pmh, pml, pm_close,
  round(seed_pv / seed_v, 6) AS seed_vwap, seed_v, seed_hi, seed_lo, or_high, or_low,
  round(ema, 6) AS ema, preopen, last_price
FROM wseeds s ASOF LEFT JOIN histday d ON s.symbol = d.symbol AND s.session > d.session""")
def warmup_seeds(spark, sf_dir):
    t = warm_tape(spark, sf_dir)
    keys = t.seeds.select(*K, "open_us", (F.col("session") * V.DAY_US).alias("day_us"))
    none = [F.lit(None).cast("double").alias(c) for c in ("high", "low", "close")]
    prior = S.prior_day_levels(keys.select(*K, *none, "open_us", "day_us"), P, warmup.day_bars(t.warm.days))
    out = t.seeds.join(prior, K, "left")
    return out.select(
        *K, "pdh", "pdl", "pdc", "pmh", "pml", "pm_close",
        r(F.col("seed_pv") / F.col("seed_v")).alias("seed_vwap"), "seed_v", "seed_hi", "seed_lo",
        "or_high", "or_low", r(F.col("ema")).alias("ema"), "preopen", "last_price",
    )


cte("wsided", "trades quotes starts wseeds", """
SELECT t.*, CASE WHEN NOT fl THEN 0 WHEN price >= ask THEN 1 WHEN price <= bid THEN -1
       WHEN price > (ask + bid) * 0.5 THEN 1 WHEN price < (ask + bid) * 0.5 THEN -1
       WHEN price > pf THEN 1 WHEN price < pf THEN -1 ELSE 0 END AS side
FROM (SELECT x.*, s.last_price, coalesce(last_value(CASE WHEN fl THEN price END IGNORE NULLS) OVER (
        PARTITION BY x.symbol, x.session ORDER BY ts_us, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s.last_price) AS pf
  FROM trades x JOIN starts b ON x.session = b.session AND x.ts_us >= b.start_us
  LEFT JOIN wseeds s ON x.symbol = s.symbol AND x.session = s.session) t
ASOF LEFT JOIN (SELECT * FROM quotes WHERE bid > 0 AND ask >= bid) q
  ON t.symbol = q.symbol AND t.session = q.session AND t.ts_us > q.ts_us""")


@query("warm_state", "wsided wseeds", """
SELECT seq, side, round((coalesce(seed_pv, 0.0) + pv) / (coalesce(seed_v, 0) + v) + 1e-7, 4) AS vwap,
  greatest(seed_hi, hi) AS session_high, least(seed_lo, lo) AS session_low
FROM (SELECT *, sum(CASE WHEN fl AND ts_us >= open_us THEN price * size ELSE 0.0 END) OVER w AS pv,
    sum(CASE WHEN fl AND ts_us >= open_us THEN size ELSE 0 END) OVER w AS v,
    max(CASE WHEN ul AND ts_us >= open_us THEN price END) OVER w AS hi,
    min(CASE WHEN ul AND ts_us >= open_us THEN price END) OVER w AS lo
  FROM wsided WINDOW w AS (PARTITION BY symbol, session ORDER BY ts_us, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) p
LEFT JOIN (SELECT symbol, session, seed_pv, seed_v, seed_hi, seed_lo FROM wseeds) s USING (symbol, session)""")
def warm_state(spark, sf_dir):
    t = warm_tape(spark, sf_dir)
    bars = B.with_bar_windows(t.filled, (), (), (), t.seeds)
    out = B.print_windows(t.sided, bars, P, ())
    return out.select("seq", "side", r(F.col("vwap") + 1e-7, 4).alias("vwap"), "session_high", "session_low")


# the bar blocks of the whole tape, over the prints of the warmed-up one
cte("wmicro", "wsided", CTES["micro"][1].replace("FROM sided", "FROM wsided")
    .replace("min(close_us) AS close_us", "min(close_us) AS close_us, min(last_price) AS seed_price")
    .replace("1 PRECEDING), first_price)", "1 PRECEDING), seed_price, first_price)"))
cte("wpre", "wseeds", """
SELECT symbol, session, unnest(generate_series(open_us - 24 * $U, open_us - $U, $U)) AS b_us,
  pm_close AS price, open_us, close_us FROM wseeds WHERE preopen""")
cte("wbars", "wmicro wpre", """
SELECT * FROM wmicro UNION ALL
SELECT symbol, session, b_us, price, price, price, price, 0, 0, 0, 0, 0.0, 0.0, 0, NULL, NULL, NULL,
  open_us, close_us, true FROM wpre""")
cte("wfilled", "wbars", CTES["filled"][1].replace("FROM micro", "FROM wbars"))
cte("wown", "wfilled wpre", "SELECT f.* FROM wfilled f ANTI JOIN wpre p USING (symbol, session, b_us)")
cte("wmacro", "wown", CTES["macro"][1].replace("FROM filled", "FROM wown"))


@query("warm_trend", "wmacro ownhist pmhist", """
SELECT symbol, session, m_us, round(close, 4) AS close, round(ema20, 6) AS ema20, round(ema_change + 1e-10, 5) AS ema_change
FROM (SELECT *, round(ema20 - lag(ema20, 3) OVER (PARTITION BY symbol, session ORDER BY m_us), 9) AS ema_change
  FROM (SELECT *, list_reduce(list(close) OVER (PARTITION BY symbol, session ORDER BY m_us
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      lambda a, x: x * (2.0::DOUBLE / 21) + a * (1 - 2.0::DOUBLE / 21)) AS ema20
    FROM (SELECT symbol, session, m_us, close, true AS shown FROM wmacro
      UNION ALL SELECT symbol, session, m_us, close, true FROM ownhist
      UNION ALL SELECT symbol, session, m_us, close, false FROM pmhist)))
WHERE shown""")
def warm_trend(spark, sf_dir):
    t = warm_tape(spark, sf_dir)
    out = B.with_ema(t.macro, t.seeds)
    return out.select(*K, "m_us", r(F.col("close"), 4).alias("close"), r(F.col("ema20")).alias("ema20"), r(F.col("ema_change") + 1e-10, 5).alias("ema_change"))


# baselines of a tape that starts late: its own macro bars, and the bars of the sessions it missed
cte("wbase", "ticks starts wmacro ownhist look", """
SELECT symbol, l.session, idx, median(vol::DOUBLE) AS vol_med, median(n::DOUBLE) AS n_med FROM (
  SELECT symbol, session, m_us, (m_us - open_us) // $M AS idx, vol, n FROM wmacro
  WHERE traded_units > 0 AND m_us >= open_us
  UNION ALL
  SELECT symbol, session, m_us, (m_us - open_us) // $M, vol, n FROM (
    SELECT symbol, session, ts_us // $M * $M AS m_us, min(open_us) AS open_us,
      CAST(sum(size) AS BIGINT) AS vol, count(*) AS n
    FROM ticks WHERE price > 0 GROUP BY ALL) h
  WHERE m_us >= open_us AND NOT EXISTS (SELECT 1 FROM wmacro w WHERE w.symbol = h.symbol
    AND w.session = h.session AND w.m_us = h.m_us)) b
JOIN look l ON l.prior_session = b.session WHERE idx BETWEEN 0 AND 39 GROUP BY ALL""")


@query("warm_baseline", "wbase", "SELECT symbol, session, idx, vol_med, n_med FROM wbase")
def warm_baseline(spark, sf_dir):
    return warm_tape(spark, sf_dir).baseline.select(*K, "idx", "vol_med", "n_med")
