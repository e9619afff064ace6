"""Feed health as change points, and what may alert on a tape with an outage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r, r_many
from .base import HEALTH, OUTAGE_US, cte, outage_tape, query
from .ingest import TICKS

cte("every_tick", "", TICKS)
cte("came", "every_tick", f"""
SELECT * FROM every_tick WHERE size <= 70 AND NOT (ts_us % $D >= {OUTAGE_US[0]} AND ts_us % $D < {OUTAGE_US[1]})""")
cte("came_gaps", "came", """
SELECT session, ts_us AS g1, lag(ts_us) OVER (PARTITION BY session ORDER BY ts_us, seq) AS g0
FROM came QUALIFY g1 - g0 > 3 * $U""")
cte("outage_ticks", "every_tick came came_gaps", """
SELECT * FROM came
UNION ALL SELECT * FROM every_tick t WHERE seq NOT IN (SELECT seq FROM came) AND EXISTS (
  SELECT 1 FROM came_gaps g WHERE g.session = t.session AND t.ts_us BETWEEN g.g0 AND g.g1)""")
cte("came_units", "came", """
SELECT session, b_us, first_arr, last_arr, list_reduce(list(lag_units) OVER w,
    lambda a, x: a + 0.1::DOUBLE * (x - a)) AS latency, lead(first_arr) OVER w AS following
FROM (SELECT session, arr_us // $U * $U AS b_us, min(arr_us) AS first_arr, max(arr_us) AS last_arr,
    sum(arr_us - ts_us)::DOUBLE / count(*) / $U AS lag_units FROM came GROUP BY ALL)
WINDOW w AS (PARTITION BY session ORDER BY b_us)""")
cte("changes", "came_units", f"""
SELECT session, at_us, cause FROM (
  SELECT session, at_us, CASE WHEN silent_from > coalesce(silent_to, -1) THEN 'silence'
      WHEN latency > {HEALTH.feed_latency_max}::DOUBLE THEN 'latency' END AS cause
  FROM (SELECT session, at_us, last_value(f IGNORE NULLS) OVER w AS silent_from,
      last_value(t IGNORE NULLS) OVER w AS silent_to, last_value(l IGNORE NULLS) OVER w AS latency
    FROM (SELECT session, at_us, max(f) AS f, max(t) AS t, max(l) AS l FROM (
        SELECT session, b_us + $U AS at_us, NULL::BIGINT AS f, NULL::BIGINT AS t, latency AS l FROM came_units
        UNION ALL SELECT session, last_arr + 3 * $U + 1, last_arr + 3 * $U + 1, NULL, NULL FROM came_units
          WHERE coalesce(following - last_arr > 3 * $U, true)
        UNION ALL SELECT session, following, NULL, following, NULL FROM came_units
          WHERE following - last_arr > 3 * $U) GROUP BY session, at_us)
    WINDOW w AS (PARTITION BY session ORDER BY at_us)))
QUALIFY cause IS DISTINCT FROM lag(cause) OVER (PARTITION BY session ORDER BY at_us)""")


@query("health_changes", "changes", "SELECT session, at_us, cause IS NULL AS alerts_enabled, cause FROM changes")
def health_changes(spark, sf_dir):
    return outage_tape(spark, sf_dir).health


@query("candidates_alertable", "cands outage_ticks came changes", """
SELECT c.seq, c.pref, c.direction, round(c.level_price, 6) AS level_price, c.level_kind, c.is_reclaim
FROM cands c JOIN came t USING (seq)
ASOF LEFT JOIN (SELECT session, at_us, cause FROM changes) h ON t.session = h.session AND t.arr_us >= h.at_us
WHERE h.cause IS NULL""", swap={"ticks": "outage_ticks"})
def candidates_alertable(spark, sf_dir):
    """Candidates of live prints while alerts are on; bars and levels know the fetched ones as well."""
    out = outage_tape(spark, sf_dir).evaluated
    return out.select(
        "seq", "pref", "direction", r_many(F.col("level_price")).alias("level_price"), "level_kind", "is_reclaim"
    )


@query("trends_alertable", "trends changes", """
SELECT t.symbol, t.session, t.tick_us AS ts_us, t.direction, t.level_price, round(t.move_bps, 6) AS move_bps
FROM trends t
ASOF LEFT JOIN (SELECT session, at_us, cause FROM changes) h ON t.session = h.session AND t.tick_us >= h.at_us
WHERE h.cause IS NULL""", swap={"ticks": "outage_ticks"})
def trends_alertable(spark, sf_dir):
    out = outage_tape(spark, sf_dir).trends
    return out.select("symbol", "session", "ts_us", "direction", "level_price", r(F.col("move_bps")).alias("move_bps"))
