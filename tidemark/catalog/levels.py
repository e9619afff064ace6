"""Levels, sweeps, candidates, snapshots, gates, verdicts and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r, r_many
from ..operators import gates, resolve, snapshot, sweeps
from ..operators import levels as L
from .base import P, cte, query, tape

K = ["symbol", "session"]

# ------------------------------------------------------------------ macro structure

cte("mw", "ema", """
SELECT *, row_number() OVER w AS epoch,
  max(high) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS range_h,
  min(low) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS range_l,
  max(high) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS micro_h,
  min(low) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS micro_l,
  max(high) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
    - min(low) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS range5m,
  CASE WHEN count(*) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 5
    THEN avg(high - low) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS avg_range5,
  max(high) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS ext_hi,
  min(low) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS ext_lo,
  coalesce(high >= lag(high, 1) OVER w AND high >= lag(high, 2) OVER w
    AND high > lead(high, 1) OVER w AND high > lead(high, 2) OVER w, false) AS pivot_h,
  coalesce(low <= lag(low, 1) OVER w AND low <= lag(low, 2) OVER w
    AND low < lead(low, 1) OVER w AND low < lead(low, 2) OVER w, false) AS pivot_l,
  avg(high - low) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS avg3,
  avg(high - low) OVER (w ROWS BETWEEN 12 PRECEDING AND 3 PRECEDING) AS avgp,
  coalesce(high <= lag(high) OVER w AND low >= lag(low) OVER w, false) AS inside
FROM ema WINDOW w AS (PARTITION BY symbol, session ORDER BY m_us)""")
cte("mstate", "mw", """
SELECT *, coalesce(last_value(CASE WHEN range5m > 0 THEN greatest(range5m / close * 1e4, 1.0) END
    IGNORE NULLS) OVER w, 15.0) AS range5m_bps,
  CASE WHEN epoch >= 6 AND avgp > 0 THEN avg3 / avgp ELSE 1.0 END AS comp_ratio,
  epoch >= 6 AND (CASE WHEN epoch >= 6 AND avgp > 0 THEN avg3 / avgp ELSE 1.0 END) <= 0.75
    AS comp_active,
  CASE WHEN epoch >= 6 THEN least(epoch - max(CASE WHEN NOT inside THEN epoch END) OVER w, 12)
    ELSE 0 END AS tightening
FROM mw WINDOW w AS (PARTITION BY symbol, session ORDER BY m_us
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")


@query("range_levels", "mw", """
SELECT symbol, session, m_us, range_h, range_l, micro_h, micro_l FROM mw""")
def range_levels(spark, sf_dir):
    return L.range_levels(tape(spark, sf_dir).macro).select(
        *K, "m_us", "range_h", "range_l", "micro_h", "micro_l"
    )


@query("range5m", "mstate", """
SELECT symbol, session, m_us, round(range5m_bps, 6) AS range5m_bps FROM mstate""")
def range5m(spark, sf_dir):
    out = tape(spark, sf_dir).structure
    return out.select(*K, "m_us", r(F.col("range5m_bps")).alias("range5m_bps"))


@query("swing_pivots", "mw", """
SELECT symbol, session, m_us, pivot_h, pivot_l, high, low FROM mw WHERE pivot_h OR pivot_l""")
def swing_pivots(spark, sf_dir):
    out = L.with_pivots(tape(spark, sf_dir).macro).filter("pivot_h or pivot_l")
    return out.select(*K, "m_us", "pivot_h", "pivot_l", "high", "low")


cte("fives", "mw", """
SELECT a.symbol, a.session, a.epoch, (b.epoch - greatest(1, a.epoch - 39)) // 5 AS k,
  max(b.high) AS h, min(b.low) AS l
FROM mw a JOIN mw b ON a.symbol = b.symbol AND a.session = b.session
  AND b.epoch BETWEEN greatest(1, a.epoch - 39) AND a.epoch
GROUP BY ALL HAVING count(*) = 5""")
cte("turns5", "fives", """
SELECT *, h > lag(h) OVER w AND h > lead(h) OVER w AS top, l < lag(l) OVER w AND l < lead(l) OVER w
  AS bottom
FROM fives WINDOW w AS (PARTITION BY symbol, session, epoch ORDER BY k)""")


@query("swing5_pivots", "turns5 mw", """
SELECT m.symbol, m.session, m.m_us, 14 AS kind, h AS price FROM turns5 t JOIN mw m
  USING (symbol, session, epoch) WHERE top
UNION ALL SELECT m.symbol, m.session, m.m_us, 15, l FROM turns5 t JOIN mw m
  USING (symbol, session, epoch) WHERE bottom""")
def swing5_pivots(spark, sf_dir):
    rows = L.swing5_levels(tape(spark, sf_dir).macro)
    parts = [
        rows.select(*K, "m_us", F.lit(k).alias("kind"), F.explode(c).alias("price"))
        for c, k in (("swing5_h", 14), ("swing5_l", 15))
    ]
    return parts[0].unionByName(parts[1])


@query("compression", "mstate", """
SELECT symbol, session, m_us, round(comp_ratio, 6) AS comp_ratio, comp_active FROM mstate""")
def compression(spark, sf_dir):
    out = L.compression(tape(spark, sf_dir).macro, P)
    return out.select(*K, "m_us", r(F.col("comp_ratio")).alias("comp_ratio"), "comp_active")


@query("tightening", "mstate", """
SELECT symbol, session, m_us, CAST(tightening AS BIGINT) AS tightening FROM mstate""")
def tightening(spark, sf_dir):
    return L.compression(tape(spark, sf_dir).macro, P).select(*K, "m_us", "tightening")


# ------------------------------------------------------------------ level lists

cte("statics", "prior premarket", """
SELECT * FROM (
  SELECT symbol, session, pdh AS price, 0 AS prio, 0 AS kind FROM prior
  UNION ALL SELECT symbol, session, pdl, 0, 1 FROM prior
  UNION ALL SELECT symbol, session, pdc, 1, 2 FROM prior
  UNION ALL SELECT symbol, session, pmh, 1, 3 FROM premarket
  UNION ALL SELECT symbol, session, pml, 1, 4 FROM premarket) WHERE price > 0""")
cte("openlv", "opening", """
SELECT symbol, session, or_eff_us, or_high AS price, 2 AS prio, 5 AS kind FROM opening
UNION ALL SELECT symbol, session, or_eff_us, or_low, 2, 6 FROM opening""")
cte("dynlv", "mw turns5", """
SELECT symbol, session, epoch, range_h AS price, 6 AS prio, 8 AS kind FROM mw
UNION ALL SELECT symbol, session, epoch, range_l, 6, 9 FROM mw
UNION ALL SELECT symbol, session, epoch, micro_h, 7, 10 FROM mw
UNION ALL SELECT symbol, session, epoch, micro_l, 7, 11 FROM mw
UNION ALL SELECT symbol, session, epoch, h, 4, 14 FROM turns5 WHERE top
UNION ALL SELECT symbol, session, epoch, l, 4, 15 FROM turns5 WHERE bottom
UNION ALL SELECT symbol, session, epoch, price, 5, kind FROM (
  SELECT a.symbol, a.session, a.epoch, p.price, p.kind FROM mw a
  JOIN (SELECT symbol, session, epoch, high AS price, 12 AS kind FROM mw WHERE pivot_h
        UNION ALL SELECT symbol, session, epoch, low, 13 FROM mw WHERE pivot_l) p
    ON a.symbol = p.symbol AND a.session = p.session
   AND p.epoch BETWEEN a.epoch - 37 AND a.epoch - 2
  QUALIFY row_number() OVER (PARTITION BY a.symbol, a.session, a.epoch, p.kind
    ORDER BY p.epoch DESC) <= 3)""")
cte("bepoch", "flowwin mw", """
SELECT b.*, coalesce(m.epoch, 0) AS epoch FROM (
  SELECT symbol, session, b_us, arg_min(vwap, ts_us) AS vwap0 FROM flowwin WHERE ul
  GROUP BY ALL) b
ASOF LEFT JOIN (SELECT symbol, session, epoch, eff_us FROM mw) m
  ON b.symbol = m.symbol AND b.session = m.session AND b.b_us >= m.eff_us""")
cte("lvsrc", "statics openlv dynlv bepoch mw", """
SELECT symbol, session, epoch AS gk, price, prio, kind FROM dynlv
UNION ALL SELECT m.symbol, m.session, m.epoch, s.price, s.prio, s.kind
  FROM (SELECT symbol, session, epoch FROM mw
        UNION ALL SELECT DISTINCT symbol, session, 0 FROM mw) m
  JOIN statics s USING (symbol, session)
UNION ALL SELECT m.symbol, m.session, m.epoch, o.price, o.prio, o.kind FROM mw m JOIN openlv o
  ON m.symbol = o.symbol AND m.session = o.session AND o.or_eff_us <= m.eff_us
UNION ALL SELECT b.symbol, b.session, b.b_us, d.price, d.prio, d.kind
  FROM bepoch b JOIN dynlv d USING (symbol, session, epoch)
UNION ALL SELECT b.symbol, b.session, b.b_us, s.price, s.prio, s.kind
  FROM bepoch b JOIN statics s USING (symbol, session)
UNION ALL SELECT b.symbol, b.session, b.b_us, o.price, o.prio, o.kind FROM bepoch b JOIN openlv o
  ON b.symbol = o.symbol AND b.session = o.session AND o.or_eff_us <= b.b_us
UNION ALL SELECT symbol, session, b_us, vwap0, 3, 7 FROM bepoch WHERE vwap0 > 0""")
cte("lvrank", "lvsrc", """
SELECT *, row_number() OVER (PARTITION BY symbol, session, gk ORDER BY price, prio, kind) AS i
FROM lvsrc""")
cte("lvchain", "lvrank", """RECURSIVE
SELECT symbol, session, gk, i, 1 AS chain, price, prio, kind FROM lvrank WHERE i = 1
UNION ALL
SELECT symbol, session, gk, i, CASE WHEN far THEN chain + 1 ELSE chain END,
  CASE WHEN far OR nprio < prio THEN nprice ELSE price END,
  CASE WHEN far OR nprio < prio THEN nprio ELSE prio END,
  CASE WHEN far OR nprio < prio THEN nkind ELSE kind END
FROM (SELECT m.symbol, m.session, m.gk, n.i, m.chain, m.price, m.prio, m.kind, n.price AS nprice,
    n.prio AS nprio, n.kind AS nkind, abs(n.price - m.price) / m.price * 1e4 >= 2.0 AS far
  FROM lvchain m JOIN lvrank n ON m.symbol = n.symbol AND m.session = n.session AND m.gk = n.gk
    AND n.i = m.i + 1)""")
cte("lvmerged", "lvchain", """
SELECT symbol, session, gk, chain, arg_max(price, i) AS price, arg_max(prio, i) AS prio,
  arg_max(kind, i) AS kind FROM lvchain GROUP BY symbol, session, gk, chain""")


@query("static_levels", "statics", "SELECT symbol, session, kind, price FROM statics")
def static_levels(spark, sf_dir):
    s = tape(spark, sf_dir).static
    return s.select(*K, F.explode("static").alias("x")).select(*K, "x.kind", "x.price")


@query("levels_interval", "dynlv mw openlv", """
SELECT symbol, session, kind, price, eff_us, until_us, count(*) AS levels FROM (
  SELECT d.symbol, d.session, d.kind, d.price, m.eff_us,
    m.nxt AS until_us
  FROM dynlv d JOIN (SELECT symbol, session, epoch, eff_us, lead(eff_us) OVER (
    PARTITION BY symbol, session ORDER BY m_us) AS nxt FROM mw) m USING (symbol, session, epoch)
  UNION ALL SELECT symbol, session, kind, price, or_eff_us, NULL FROM openlv) GROUP BY ALL""")
def levels_interval(spark, sf_dir):
    """Every non-static level with the interval in which it may be used."""
    from pyspark.sql.window import Window as W

    t = tape(spark, sf_dir)
    nxt = F.lead("eff_us").over(W.partitionBy(*K).orderBy("m_us"))
    dyn = t.structure.withColumn("until_us", nxt)
    dyn = dyn.select(*K, F.explode("dynamic").alias("x"), "eff_us", "until_us")
    dyn = dyn.select(*K, "x.kind", "x.price", "eff_us", "until_us")
    none = F.lit(None).cast("bigint").alias("until_us")
    o = [
        t.opening.select(*K, F.lit(k).alias("kind"), F.col(c).alias("price"),
                         F.col("or_eff_us").alias("eff_us"), none)
        for c, k in (("or_high", 5), ("or_low", 6))
    ]
    rows = dyn.unionByName(o[0]).unionByName(o[1])
    return rows.groupBy(*K, "kind", "price", "eff_us", "until_us").agg(
        F.count("*").alias("levels")
    )


@query("merge_levels", "lvmerged", """
SELECT symbol, session, gk AS b_us, kind, prio, round(price, 6) AS price FROM lvmerged
WHERE gk > 1000000""")
def merge_levels(spark, sf_dir):
    lv = tape(spark, sf_dir).bucket_levels
    out = lv.select(*K, "b_us", F.explode("levels").alias("x"))
    return out.select(*K, "b_us", "x.kind", "x.prio", r(F.col("x.price")).alias("price"))


# ------------------------------------------------------------------ sweeps

cte("lives", "lvmerged", """
SELECT *, epoch - row_number() OVER (PARTITION BY symbol, session, kind, cents ORDER BY epoch)
  AS life
FROM (SELECT DISTINCT symbol, session, gk AS epoch, kind, round(price, 2) AS cents FROM lvmerged
      WHERE gk < 1000000)""")
cte("watch", "flowwin bepoch lvmerged lives", """
SELECT p.symbol, p.session, p.ts_us, p.seq, p.price, l.price AS level, l.kind,
  round(l.price, 2) AS cents, coalesce(v.life, -1000000 - b.epoch) AS life,
  p.price > l.price AS above
FROM flowwin p JOIN bepoch b USING (symbol, session, b_us)
JOIN lvmerged l ON p.symbol = l.symbol AND p.session = l.session AND l.gk = p.b_us
LEFT JOIN lives v ON v.symbol = p.symbol AND v.session = p.session AND v.epoch = b.epoch
  AND v.kind = l.kind AND v.cents = round(l.price, 2)
WHERE p.ul""")
cte("walk", "watch", """
SELECT *, sum(turn::INT) OVER (PARTITION BY symbol, session, kind, cents, life
    ORDER BY ts_us, seq, level ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
FROM (SELECT *, coalesce(above <> lag(above) OVER (PARTITION BY symbol, session, kind, cents, life
    ORDER BY ts_us, seq, level), false) AS turn FROM watch)""")
cte("reclaims", "walk", """
SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY ts_us, seq, level, kind) AS r_idx
FROM (SELECT w.symbol, w.session, w.ts_us, w.seq, w.level, w.kind,
    CASE WHEN i.was_above THEN -1 ELSE 1 END AS direction,
    CASE WHEN i.was_above THEN i.hi ELSE i.lo END AS swept_extreme
  FROM walk w JOIN (
    SELECT symbol, session, kind, cents, life, island, min(ts_us) AS since, first(above) AS was_above,
      max(price) AS hi, min(price) AS lo FROM walk GROUP BY ALL) i
    ON w.symbol = i.symbol AND w.session = i.session AND w.kind = i.kind AND w.cents = i.cents
   AND w.life = i.life AND w.island = i.island + 1
  WHERE w.turn AND w.ts_us - i.since <= 24 * $U
    AND abs(CASE WHEN i.was_above THEN i.hi ELSE i.lo END - w.level) / w.level * 1e4 <= 60.0)""")


@query("sweep_reclaim", "reclaims", """
SELECT symbol, session, ts_us, seq, kind, round(level, 6) AS level, direction, swept_extreme
FROM reclaims""")
def sweep_reclaim(spark, sf_dir):
    out = tape(spark, sf_dir).reclaims
    return out.select(
        *K, "ts_us", "seq", "kind", r(F.col("level")).alias("level"), "direction", "swept_extreme"
    )


cte("eligible", "flowwin", "SELECT * FROM flowwin WHERE ul AND fl AND ts_us >= open_us")
cte("active", "eligible reclaims", """
SELECT e.symbol, e.session, e.ts_us, e.seq, e.price, r.r_idx, r.ts_us AS r_ts_us,
  r.level AS level_price, r.kind AS level_kind, r.direction
FROM eligible e JOIN reclaims r ON r.symbol = e.symbol AND r.session = e.session AND r.ts_us <= e.ts_us
  AND e.ts_us - r.ts_us <= 5 * $U""")


@query("active_reclaims", "active", """
SELECT seq, r_idx, r_ts_us, level_kind, round(level_price, 6) AS level_price, direction
FROM active""")
def active_reclaims(spark, sf_dir):
    t = tape(spark, sf_dir)
    prints = t.sided.filter(snapshot.may_evaluate()).select(*K, "ts_us", "seq", "price")
    out = sweeps.active_reclaims(prints, t.reclaims, P)
    return out.select(
        "seq", "r_idx", "r_ts_us", "level_kind", r_many(F.col("level_price")).alias("level_price"),
        "direction",
    )


# ------------------------------------------------------------------ candidates

cte("nearest", "eligible lvmerged", """
SELECT e.seq, arg_max(l.price, l.price) FILTER (l.price < e.price) AS up_price,
  arg_max(l.kind, l.price) FILTER (l.price < e.price) AS up_kind,
  arg_min(l.price, l.price) FILTER (l.price > e.price) AS dn_price,
  arg_min(l.kind, l.price) FILTER (l.price > e.price) AS dn_kind
FROM eligible e JOIN lvmerged l
  ON e.symbol = l.symbol AND e.session = l.session AND l.gk = e.b_us
WHERE abs(e.price - l.price) <= e.price * ((@ready_bps@ + @break_max_bps@) / 1e4)
GROUP BY e.seq""")


@query("nearest_level", "nearest", """
SELECT seq, round(up_price, 6) AS up_price, up_kind, round(dn_price, 6) AS dn_price, dn_kind
FROM nearest WHERE up_price IS NOT NULL OR dn_price IS NOT NULL""")
def nearest_level(spark, sf_dir):
    rows = tape(spark, sf_dir).leveled.filter(snapshot.may_evaluate())
    frac = (P.ready_bps + P.break_max_bps) / 1e4
    price = F.col("price")
    out = rows.select(
        "seq",
        L.nearest(F.col("levels"), price, frac, 1).alias("u"),
        L.nearest(F.col("levels"), price, frac, -1).alias("d"),
    )
    return out.filter("u is not null or d is not null").select(
        "seq", r(F.col("u.price")).alias("up_price"), F.col("u.kind").alias("up_kind"),
        r(F.col("d.price")).alias("dn_price"), F.col("d.kind").alias("dn_kind"),
    )


cte("cands", "nearest active", """
SELECT seq, 0 AS pref, 1 AS direction, up_price AS level_price, up_kind AS level_kind,
  false AS is_reclaim FROM nearest WHERE up_price IS NOT NULL
UNION ALL SELECT seq, 1, -1, dn_price, dn_kind, false FROM nearest WHERE dn_price IS NOT NULL
UNION ALL SELECT seq, r_idx + 2, direction, level_price, level_kind, true FROM active
WHERE (price - level_price) * direction > 0""")


@query("candidates", "cands", """
SELECT seq, pref, direction, round(level_price, 6) AS level_price, level_kind, is_reclaim
FROM cands""")
def candidates(spark, sf_dir):
    out = tape(spark, sf_dir).evaluated
    return out.select(
        "seq", "pref", "direction", r_many(F.col("level_price")).alias("level_price"), "level_kind",
        "is_reclaim",
    )


_VERB = """CASE WHEN is_reclaim THEN 'reclaim' WHEN level_kind = 7 THEN 'cross'
  WHEN level_kind IN (12, 13, 14, 15) THEN 'pivot' WHEN level_kind = 2 THEN 'cross'
  WHEN (level_kind IN (0, 3, 5, 8, 10, 12, 14)) <> (direction > 0) THEN 'reject'
  ELSE 'break' END"""

cte("snaps", "cands features0 persist context mstate", f"""
SELECT c.*, f.symbol, f.session, f.ts_us, f.price, f.open_us, f.close_us, f.idx, f.minute_frac,
  f.vel5, f.vel15, f.v5, f.v60, f.base_vol, f.vol_ratio_prev, f.vol_ratio_base, f.imb5, f.imb15,
  f.buy_share5, f.n_ratio_prev, f.range_exp, f.dist_vwap_bps, f.spread_bps, f.quote_imb,
  (f.price - level_price) / level_price * 1e4 * direction AS break_bps,
  vel5 * direction > 0 AND (vel15 * direction <= 0
    OR vel5 * direction >= @accel_ratio@ * (vel15 * direction)) AS accelerating,
  {_VERB} AS trigger_verb, p.n2s,
  CASE WHEN direction > 0 THEN persist_up ELSE persist_dn END AS persist_trades,
  CASE WHEN direction > 0 THEN span_up ELSE span_dn END AS persist_span,
  CASE WHEN direction > 0 THEN dom_up ELSE dom_dn END AS dominant_frac,
  x.mkt_1m * direction AS mkt_al_1m, x.mkt_5m * direction AS mkt_al_5m, x.fear_1m, x.fear_5m,
  coalesce(m.comp_ratio, 1.0) AS comp_ratio, coalesce(m.comp_active, false) AS comp_active,
  coalesce(m.range5m_bps, 15.0) AS range5m_bps
FROM cands c JOIN features0 f USING (seq) JOIN persist p USING (seq)
JOIN context x ON x.session = f.session AND x.b_us = f.b_us
ASOF LEFT JOIN (SELECT symbol, session, eff_us, comp_ratio, comp_active, range5m_bps FROM mstate) m
  ON f.symbol = m.symbol AND f.session = m.session AND f.b_us >= m.eff_us""")

SNAP_NUM = (
    "level_price", "break_bps", "vel5", "vel15", "vol_ratio_prev", "vol_ratio_base", "imb5",
    "imb15", "n_ratio_prev", "range_exp", "comp_ratio", "dist_vwap_bps", "spread_bps",
    "quote_imb", "minute_frac", "persist_span", "dominant_frac", "mkt_al_1m", "mkt_al_5m",
    "fear_1m", "fear_5m",
)
SNAP_RAW = ("symbol", "seq", "pref", "direction", "price", "level_kind", "trigger_verb",
            "accelerating", "comp_active", "persist_trades", "n2s")


def _rounded(cols) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def _take(df, raw, num):
    return df.select(*raw, *[r(F.col(c)).alias(c) for c in num])


OF_LEVEL = ("level_price", "break_bps", "score", "level_major", "is_reclaim")
FOR_LEVEL = ("ts_us", "price", "near", "penalty", "comp_active", "score_flow", "score_range", "score_comp", "break_cap",
             "risk_bps", "way_reason")


def _judged(t, raw, num):
    """Columns of all candidates, rounded ahead of the levels where no level changes them."""
    ahead = {f"_r_{k}": r_many(v) for k, v in num.items() if k not in OF_LEVEL}
    own = {*K, "seq", "direction", *FOR_LEVEL, *raw}
    ways = t.ways.select(*[c for c in t.ways.columns if c in own], *[v.alias(k) for k, v in ahead.items()])
    # written, so that many expressions and the join are compiled apart
    rows = t.judged(t.stage(ways, "rounded") if len(ahead) > 1 else ways)
    return rows.select(*raw, *[(F.col(f"_r_{k}") if f"_r_{k}" in ahead else r_many(v)).alias(k) for k, v in num.items()])


@query("snapshots", "snaps", f"SELECT {', '.join(SNAP_RAW)}, {_rounded(SNAP_NUM)} FROM snaps")
def snapshots(spark, sf_dir):
    return _judged(tape(spark, sf_dir), SNAP_RAW, {k: F.col(k) for k in SNAP_NUM})


@query("trigger_verb", "snaps", """
SELECT level_kind, direction, is_reclaim, trigger_verb, count(*) AS candidates FROM snaps
GROUP BY ALL""")
def trigger_verb(spark, sf_dir):
    return (
        tape(spark, sf_dir)
        .evaluated.groupBy("level_kind", "direction", "is_reclaim", "trigger_verb")
        .agg(F.count("*").alias("candidates"))
    )


_FEATURE_SQL = {
    "dir": "direction::DOUBLE", "break_bps": "break_bps", "vel5": "vel5 * direction",
    "vel15": "vel15 * direction", "accel": "accelerating::INT::DOUBLE",
    "vol_prev": "least(vol_ratio_prev, 20.0)", "vol_base": "least(vol_ratio_base, 20.0)",
    "imb5": "imb5 * direction", "imb15": "imb15 * direction",
    "n_prev": "least(n_ratio_prev, 20.0)", "range_exp": "least(range_exp, 10.0)",
    "comp": "least(comp_ratio, 3.0)",
    "dist_vwap": "greatest(-100.0, least(100.0, dist_vwap_bps * direction))",
    "spread": "least(spread_bps, 50.0)", "q_imb": "quote_imb * direction",
    "minute": "minute_frac", "persist": "persist_trades::DOUBLE", "dominance": "dominant_frac",
    "mkt_al_1m": "mkt_al_1m", "mkt_al_5m": "mkt_al_5m", "fear_1m": "fear_1m",
    "fear_5m": "fear_5m", "level_major": "(level_kind IN (0, 1, 3, 4, 5, 6))::INT::DOUBLE",
    "is_reclaim": "(trigger_verb = 'reclaim')::INT::DOUBLE", "trend": "0.0",
}


@query("features", "snaps", "SELECT seq, pref, " + ", ".join(
    f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in _FEATURE_SQL.items()) + " FROM snaps")
def features(spark, sf_dir):
    return _judged(tape(spark, sf_dir), ("seq", "pref"), snapshot.feature_columns())


# ------------------------------------------------------------------ score and gates

INVALIDATION = """CAST(round(CAST(CAST(level_price * (1.0 - direction
    * greatest(@invalidation_min_bps@, least(@invalidation_max_bps@, @invalidation_range_frac@
      * CASE WHEN minute_frac * 40.0 < @open_phase_min@
        THEN greatest(range5m_bps, @open_range_floor_bps@) ELSE range5m_bps END)) / 1e4)
    AS VARCHAR) AS DECIMAL(30, 18)), 4) AS DOUBLE)"""

cte("scored", "snaps", """
SELECT *, CASE WHEN score - penalty < need THEN CASE WHEN score >= need THEN 'fake_start'
    ELSE 'score' END END AS score_reason
FROM (SELECT *,
  greatest(0.0, least(1.0,
    0.25 * v_vol + 0.15 * v_base + 0.20 * least(abs(imb5) / 0.6::DOUBLE, 1.0)
    + 0.20 * greatest(least(vel5 * direction / (3.0 * @vel_min_bps_s@), 1.0), 0.0)
    + 0.10 * (1.0 - least(break_bps / greatest(@break_max_bps@, 1.0), 1.0))
    + 0.05 * least(range_exp / 3.0, 1.0)
    + 0.05 * greatest(1.0 - least(comp_ratio, 1.5) / 1.5::DOUBLE, 0.0))) AS score,
  CASE WHEN 1.0 - vol_ratio_prev / 6.0 <= 0 THEN 0.0 ELSE @fake_start_weight@
    * (1.0 - vol_ratio_prev / 6.0) * greatest(
      least(greatest(comp_ratio - @comp_veto_ratio@, 0.0) / 0.5::DOUBLE, 1.0),
      least(greatest(imb15 * direction - @imb15_blowoff_max@, 0.0) / 0.25::DOUBLE, 1.0)) END
    AS penalty,
  greatest(@score_floor@, @score_min@ * CASE WHEN comp_active THEN 0.9::DOUBLE ELSE 1.0 END) AS need,
  """ + INVALIDATION + """ AS invalidation
FROM (SELECT *, least(vol_ratio_prev / (2.0 * @vol_accel_min@), 1.0) AS v_vol,
    CASE WHEN vol_ratio_base > 0 THEN least(vol_ratio_base / (2.0 * greatest(0.5::DOUBLE,
      @vol_accel_min@ * 0.75::DOUBLE)), 1.0) ELSE least(vol_ratio_prev / (2.0 * @vol_accel_min@), 1.0) END
      AS v_base FROM snaps))""")
cte("gated", "scored", """
SELECT *, CASE WHEN break_bps < @break_min_bps@ THEN 'untriggered'
  WHEN break_bps > CASE WHEN minute_frac * 40.0 < @open_phase_min@ THEN @break_max_open_bps@
    ELSE @break_max_bps@ END THEN 'extended'
  WHEN vel5 * direction < @vel_min_bps_s@ THEN 'velocity'
  WHEN NOT accelerating THEN 'not_accelerating'
  WHEN vel15 * direction > @vel15_max_bps_s@ THEN 'late_chase'
  WHEN range_exp > @range_exp_max@ AND vol_ratio_prev < @fresh_break_vol_max@ THEN 'late_chase'
  WHEN vol_ratio_prev < @vol_accel_min@ THEN 'volume_accel'
  WHEN vol_ratio_base > 0 AND vol_ratio_base < @vol_base_min@ THEN 'volume_baseline'
  WHEN imb5 * direction < @imb_min@ THEN 'imbalance'
  WHEN imb15 * direction < @imb15_min@ THEN 'imbalance_15s'
  WHEN n2s < @min_trades_2s@ OR dominant_frac > @single_print_max_frac@ THEN 'single_print'
  WHEN persist_trades < @persist_min_trades@ THEN 'persistence_count'
  WHEN persist_span < @persist_min_span_s@ THEN 'persistence_span'
  ELSE score_reason END AS gate_reason FROM scored""")


@query("score", "scored", "SELECT seq, pref, round(score, 6) AS score FROM scored")
def score(spark, sf_dir):
    return _judged(tape(spark, sf_dir), ("seq", "pref"), {"score": F.col("score")})


@query("penalty", "scored", "SELECT seq, pref, round(penalty, 6) AS penalty FROM scored")
def penalty(spark, sf_dir):
    return _judged(tape(spark, sf_dir), ("seq", "pref"), {"penalty": F.col("penalty")})


@query("gate_reason", "gated", "SELECT seq, pref, gate_reason FROM gated")
def gate_reason(spark, sf_dir):
    return tape(spark, sf_dir).evaluated.select("seq", "pref", "gate_reason")


@query("invalidation", "scored", "SELECT seq, pref, invalidation FROM scored")
def invalidation(spark, sf_dir):
    return tape(spark, sf_dir).evaluated.select("seq", "pref", "invalidation")


@query("rejection_counts", "gated", """
SELECT symbol, gate_reason AS reason, count(*) AS rejections FROM gated
WHERE gate_reason <> 'untriggered' GROUP BY ALL""")
def rejection_counts(spark, sf_dir):
    return gates.rejection_counts(tape(spark, sf_dir).evaluated)


# ------------------------------------------------------------------ trend onset

cte("ticks1", "barwin looked mstate context", """
SELECT w.*, l.base_vol, coalesce(m.epoch, 0) AS epoch, m.ext_hi, m.ext_lo, m.ema_change,
  coalesce(m.range5m_bps, 15.0) AS range5m_bps,
  x.mkt_5m, x.fear_5m, w.b_us + $U AS tick_us
FROM barwin w JOIN looked l USING (symbol, session, b_us) JOIN context x
  ON x.session = w.session AND x.b_us = w.b_us
ASOF LEFT JOIN (SELECT symbol, session, eff_us, epoch, ext_hi, ext_lo, ema_change, range5m_bps
  FROM mstate) m
  ON w.symbol = m.symbol AND w.session = m.session AND w.b_us >= m.eff_us""")
cte("trends", "ticks1 premarket", """
SELECT * FROM (SELECT *, CASE WHEN move_bps > 0 THEN 1 ELSE -1 END AS direction,
    CASE WHEN b60 + s60 > 0 THEN CASE WHEN move_bps > 0 THEN b60 ELSE s60 END / (b60 + s60)::DOUBLE END
      AS share,
    CASE WHEN move_bps > 0 THEN CASE WHEN epoch < 6 THEN greatest(ext_hi, pmh) ELSE ext_hi END
      ELSE CASE WHEN epoch < 6 THEN least(ext_lo, pml) ELSE ext_lo END END AS level_price,
    CASE WHEN base_vol > 0 THEN v60 / base_vol ELSE 0.0 END AS vol_ratio
  FROM (SELECT t.*, p.pmh, p.pml, (close - ago) / ago * 1e4 AS move_bps
    FROM (SELECT *, p_vol60 + vol AS v60, p_buy_vol60 + buy_vol AS b60,
        p_sell_vol60 + sell_vol AS s60,
        lag(close, 12) OVER (PARTITION BY symbol, session ORDER BY b_us) AS ago FROM ticks1) t
    LEFT JOIN premarket p USING (symbol, session)
    WHERE tick_us >= open_us + 12 * $U)
  WHERE abs(move_bps) >= @trend_min_bps@)
WHERE share >= @trend_dir_share_min@ AND (base_vol <= 0 OR v60 >= @trend_vol_base_min@ * base_vol)
  AND (epoch >= 6 OR (epoch >= 3 AND (pmh IS NOT NULL OR pml IS NOT NULL)))
  AND CASE WHEN direction > 0 THEN close > level_price ELSE close < level_price END""")


@query("trend_onset", "trends", """
SELECT symbol, session, tick_us AS ts_us, direction, level_price, close AS price,
  round(move_bps, 6) AS move_bps, round(share, 6) AS share, round(vol_ratio, 6) AS vol_ratio
FROM trends""")
def trend_onset(spark, sf_dir):
    return _take(
        tape(spark, sf_dir).trends,
        (*K, "ts_us", "direction", "level_price", "price"),
        ("move_bps", "share", "vol_ratio"),
    )


# ------------------------------------------------------------------ verdicts and labels

cte("contend", "passed trends", f"""
SELECT symbol, session, ts_us, seq, pref, direction, price, level_price, level_kind,
  trigger_verb, invalidation, minute_frac, score, false AS is_trend, open_us, close_us FROM passed
UNION ALL
SELECT symbol, session, tick_us, 0, 1000000000, direction, close, level_price,
  CASE WHEN direction > 0 THEN 8 ELSE 9 END, 'trend', {INVALIDATION}, minute_frac, 0.0, true,
  open_us, close_us
FROM (SELECT *, least(1.0, ((tick_us - open_us) // $M) / 40.0::DOUBLE) AS minute_frac FROM trends)
""")
cte("obs", "features0 context mstate ticks1", """
SELECT f.symbol, f.session, f.ts_us AS o_ts, 1 AS o_prio, f.seq AS o_seq, f.price AS o_price,
  f.imb5, f.buy_share5 AS share5, f.v5 AS vol5, m.ema_change / f.price * 1e4 AS slope,
  x.mkt_5m AS o_mkt, x.fear_5m AS o_fear,
  CASE WHEN f.base_vol > 0 THEN f.v60 / f.base_vol ELSE 0.0 END AS o_vol
FROM features0 f JOIN context x ON x.session = f.session AND x.b_us = f.b_us
ASOF LEFT JOIN (SELECT symbol, session, eff_us, ema_change FROM mstate) m
  ON f.symbol = m.symbol AND f.session = m.session AND f.b_us >= m.eff_us
WHERE f.ul
UNION ALL
SELECT symbol, session, tick_us, 0, 0, close,
  CASE WHEN buy + sell > 0 THEN (buy - sell) / (buy + sell)::DOUBLE ELSE 0.0 END,
  CASE WHEN buy + sell > 0 THEN buy / (buy + sell)::DOUBLE ELSE 0.5 END,
  p_vol5 + vol, ema_change / close * 1e4, mkt_5m, fear_5m,
  CASE WHEN base_vol > 0 THEN (p_vol60 + vol) / base_vol ELSE 0.0 END
FROM (SELECT *, p_buy_vol5 + buy_vol AS buy, p_sell_vol5 + sell_vol AS sell FROM ticks1)""")
FUTURE = """
SELECT c.seq, c.pref, c.symbol, c.session, c.ts_us, c.direction, c.price, c.level_price,
  c.invalidation, c.minute_frac * 40.0 < @open_phase_min@ AS in_open, o.* EXCLUDE (symbol, session)
FROM $SRC c JOIN obs o ON c.symbol = o.symbol AND c.session = o.session
  AND (o.o_ts > c.ts_us OR (o.o_ts = c.ts_us AND o.o_prio = 1 AND o.o_seq > c.seq))
  AND o.o_ts <= c.ts_us + 11 * $U"""
# ticks where a symbol has no bars: deadlines of candidates, and while the flow windows run empty
TIMERS = """
SELECT symbol, session, t_b + $U AS o_ts, 0 AS o_prio, 0 AS o_seq, close AS o_price,
  CASE WHEN buy + sell > 0 THEN (buy - sell) / (buy + sell)::DOUBLE ELSE 0.0 END AS imb5,
  CASE WHEN buy + sell > 0 THEN buy / (buy + sell)::DOUBLE ELSE 0.5 END AS share5, vol5, slope, mkt_5m, fear_5m, o_vol
FROM (SELECT *, coalesce(list_sum(list_transform(fl, lambda x: x.b)), 0) AS buy,
    coalesce(list_sum(list_transform(fl, lambda x: x.s)), 0) AS sell,
    coalesce(list_sum(list_transform(fl, lambda x: x.v)), 0) AS vol5
  FROM (SELECT t.symbol, t.session, t.t_b, l.close, k.ema_change / k.close * 1e4 AS slope, k.mkt_5m, k.fear_5m,
      CASE WHEN k.base_vol > 0 THEN (k.p_vol60 + k.vol) / k.base_vol ELSE 0.0 END AS o_vol,
      CASE WHEN (t.t_b - l.b_us) // $U < 5
        THEN l.fl[greatest(len(l.fl) - (4 - (t.t_b - l.b_us) // $U), 1):] ELSE [] END AS fl
    FROM (SELECT DISTINCT symbol, session, t_b FROM (
        SELECT symbol, session, close_us, (ts_us + 9 * $U + $U - 1) // $U * $U - $U AS t_b FROM $SRC
        UNION ALL
        SELECT symbol, session, close_us,
          unnest(generate_series(b_us + $U, least(coalesce(nb - $U, b_us + 5 * $U), b_us + 5 * $U), $U))
        FROM (SELECT *, lead(b_us) OVER (PARTITION BY symbol, session ORDER BY b_us) AS nb FROM filled)
        WHERE nb IS NULL OR nb > b_us + $U) x
      WHERE t_b + $U <= close_us AND NOT EXISTS (SELECT 1 FROM filled f WHERE f.symbol = x.symbol
        AND f.session = x.session AND f.b_us = x.t_b)) t
    ASOF JOIN (SELECT symbol, session, b_us, close, list({'b': buy_vol, 's': sell_vol, 'v': vol}) OVER (
        PARTITION BY symbol, session ORDER BY b_us ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS fl FROM filled) l
      ON t.symbol = l.symbol AND t.session = l.session AND t.t_b >= l.b_us
    LEFT JOIN ticks1 k ON k.symbol = l.symbol AND k.session = l.session AND k.b_us = l.b_us))"""
JUDGED = """
SELECT *, CASE
  WHEN (o_price - invalidation) * direction < 0 THEN 'FAILED:hit invalidation'
  WHEN NOT in_open AND (o_price - level_price) * direction < -@fail_buffer_bps@ / 1e4 * level_price
    AND (imb5 * direction <= 0 OR share < 0.40) THEN 'FAILED:directional volume reversed'
  WHEN waited >= 6 * $U AND full_r AND (share >= 0.5 OR imb5 * direction > 0) AND vol5 > 0
    THEN CASE WHEN slope_ok THEN 'CONFIRMED:volume sustained' ELSE 'FAILED:minute trend against' END
  WHEN waited >= 9 * $U THEN CASE
    WHEN full_r AND slope_ok THEN 'CONFIRMED:held at deadline'
    WHEN full_r THEN 'FAILED:minute trend against'
    WHEN beyond AND progress >= 0.7::DOUBLE * @confirm_min_r@ AND slope_ok
      AND (o_mkt * direction > 0.02 OR -o_fear * direction > 0.03)
      THEN 'CONFIRMED:progress with tailwind'
    WHEN beyond AND progress >= 0.9::DOUBLE * @confirm_min_r@
      AND (o_mkt * direction < -0.03 OR -o_fear * direction < -0.05)
      THEN 'FAILED:environment against'
    ELSE 'FAILED:no expansion progress' END END AS v
FROM (SELECT *, beyond AND progress >= @confirm_min_r@ AS full_r FROM (
  SELECT *, CASE WHEN abs(level_price - invalidation) > 0
      THEN (extreme - level_price) * direction / abs(level_price - invalidation) ELSE 0.0 END
      AS progress
  FROM (SELECT *, CASE WHEN direction > 0 THEN share5 ELSE 1.0 - share5 END AS share,
      (o_price - level_price) * direction > 0 AS beyond, o_ts - ts_us AS waited,
      coalesce(slope * direction >= 0, true) AS slope_ok,
      direction * greatest(price * direction, max(o_price * direction) OVER (
        PARTITION BY symbol, session, ts_us, seq, pref ORDER BY o_ts, o_prio, o_seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS extreme FROM $FUTURE)))"""
RESOLVED = """
SELECT *, split_part(v, ':', 1) AS resolution, split_part(v, ':', 2) AS reason,
  concat_ws(', ', CASE WHEN o_mkt * direction > 0.02 THEN 'market with'
      WHEN o_mkt * direction < -0.03 THEN 'market against' END,
    CASE WHEN o_fear > 0.03 THEN 'fear rising' WHEN o_fear < -0.03 THEN 'fear easing' END,
    CASE WHEN o_vol >= 5 THEN 'event tape' END) AS env
FROM $JUDGED WHERE v IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY symbol, session, ts_us, seq, pref
  ORDER BY o_ts, o_prio, o_seq) = 1"""


def verdict_blocks(src: str, tag: str) -> None:
    """Blocks future<tag>, judged<tag> and resolved<tag> over the candidates in ``src``."""
    future, judged, timed = f"future{tag}", f"judged{tag}", f"timed{tag}"
    cte(future, f"{src} obs", FUTURE.replace("$SRC", src))
    cte(f"timers{tag}", f"{src} filled ticks1", TIMERS.replace("$SRC", src))
    both = f"(SELECT * FROM obs UNION ALL SELECT * FROM timers{tag})"
    cte(timed, f"{src} obs timers{tag}", FUTURE.replace("$SRC", src).replace("JOIN obs o", f"JOIN {both} o"))
    cte(judged, timed, JUDGED.replace("$FUTURE", timed))
    cte(f"resolved{tag}", judged, RESOLVED.replace("$JUDGED", judged))


cte("passed", "gated", "SELECT * FROM gated WHERE gate_reason IS NULL")
verdict_blocks("passed", "")


@query("future_tape", "future", """
SELECT seq, pref, count(*) AS seen, max(o_price) AS hi, min(o_price) AS lo FROM future
GROUP BY ALL""")
def future_tape(spark, sf_dir):
    t = tape(spark, sf_dir)
    narrow = t.passing.select(*K, "ts_us", "seq", "pref")
    pairs = resolve.future_tape(narrow, t.observations, 11 * P.unit_us, P)
    return pairs.groupBy("seq", "pref").agg(
        F.count("*").alias("seen"), F.max("o_price").alias("hi"), F.min("o_price").alias("lo")
    )


@query("resolution", "resolved", """
SELECT seq, pref, resolution, reason, o_ts AS resolution_us, o_price AS resolution_price,
  extreme AS micro_extreme FROM resolved""")
def resolution(spark, sf_dir):
    return tape(spark, sf_dir).resolutions.select(
        "seq", "pref", "resolution", "reason", "resolution_us", "resolution_price", "micro_extreme"
    )


@query("env_clause", "resolved", "SELECT seq, pref, env FROM resolved")
def env_clause(spark, sf_dir):
    return tape(spark, sf_dir).resolutions.select("seq", "pref", "env")


OUTCOME = """
SELECT *, mfe_raw AS mfe, mae_raw AS mae, expanded AND started AND ample AS label,
  expanded AND started AND NOT ample AS was_late,
  CASE WHEN expanded AND started AND ample THEN 'expanded' WHEN NOT started THEN 'no_expansion'
    WHEN NOT expanded THEN 'insufficient_expansion' ELSE 'alert_too_late' END AS label_reason
FROM (SELECT *, pre >= @pos_multiple@ * risk AS expanded, lead_b IS NOT NULL AS started,
    left_frac >= @min_remaining_frac@ AS ample
  FROM (SELECT *, CASE WHEN total > 1e-9 THEN mfe_raw / total ELSE 0.0 END AS left_frac
    FROM (SELECT *, (price - level_price) * direction + mfe_raw AS total
      FROM (SELECT seq, pref, symbol, session, ts_us, direction, price, level_price, risk,
          greatest(max(fav), 0.0) AS mfe_raw, greatest(max(adv), 0.0) AS mae_raw,
          greatest(max(fav) FILTER (dead IS NULL OR b_us <= dead), 0.0) AS pre,
          min(b_us) FILTER (fav >= risk) AS lead_b
        FROM (SELECT *, min(CASE WHEN hit THEN b_us END) OVER (
            PARTITION BY symbol, session, ts_us, seq, pref) AS dead
          FROM (SELECT c.*, b.b_us, abs(level_price - invalidation) AS risk,
              (CASE WHEN direction > 0 THEN b.high ELSE b.low END - price) * direction AS fav,
              (price - CASE WHEN direction > 0 THEN b.low ELSE b.high END) * direction AS adv,
              (CASE WHEN direction > 0 THEN b.low ELSE b.high END - invalidation) * direction < 0
                AS hit
            FROM $SRC c JOIN filled b ON c.symbol = b.symbol AND c.session = b.session
              AND b.b_us BETWEEN c.ts_us // $U * $U AND (c.ts_us + 18 * $U) // $U * $U))
        GROUP BY ALL))))"""
cte("outcome", "passed filled", OUTCOME.replace("$SRC", "passed"))
verdict_blocks("contend", "2")
cte("outcome2", "contend filled", OUTCOME.replace("$SRC", "contend"))


@query("label_outcome", "outcome", """
SELECT seq, pref, label, label_reason, was_late, round(mfe, 6) AS mfe, round(mae, 6) AS mae,
  round((lead_b + $U - ts_us) / $U::DOUBLE, 6) AS lead_time,
  round(greatest(0.0, least(1.0, left_frac)), 6) AS remaining_frac FROM outcome WHERE risk > 0""")
def label_outcome(spark, sf_dir):
    return _take(
        tape(spark, sf_dir).labels,
        ("seq", "pref", "label", "label_reason", "was_late"),
        ("mfe", "mae", "lead_time", "remaining_frac"),
    )


@query("label_ready", "outcome filled", """
SELECT seq, pref, ts_us + 18 * $U AS due_us, last_b >= ts_us + 17 * $U AS ready FROM outcome
JOIN (SELECT symbol, session, max(b_us) AS last_b FROM filled GROUP BY ALL) USING (symbol, session)
WHERE risk > 0""")
def label_ready(spark, sf_dir):
    return tape(spark, sf_dir).labels.select("seq", "pref", "due_us", "ready")


