"""Sources, ingestion and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r
from ..functions.timefn import format_rfc3339, ntz_us, parse_rfc3339_us
from ..operators import ingest as I
from ..operators import session as S
from ..operators import sides
from ..sources import tables as T
from ..sources import views as V
from ..sources import wire
from .base import P, cte, query, tape

CONDS = " ".join(
    f"WHEN {i} THEN {list(c) if c else '[]::VARCHAR[]'}" for i, c in enumerate(V.EVENT_CONDITIONS)
)
PAIRS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.QUOTE_PAIR.items())

TICKS = f"""
SELECT event_type AS symbol, epoch_us(ts) // $D AS session, epoch_us(ts) AS ts_us, event_id AS seq,
  CASE WHEN value > 0 THEN round(100 + value / 100, 4) ELSE 0.0 END AS price,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS size,
  CASE user_id % 10 {CONDS} END AS conds,
  epoch_us(ts) + CAST(regexp_extract(props, '[0-9]+') AS BIGINT) * 60000000 AS arr_us,
  user_id % 4 AS exchange, event_id AS trade_id,
  epoch_us(ts) // $D * $D + $O AS open_us, (epoch_us(ts) // $D + 1) * $D AS close_us
FROM events"""
cte("ticks", "", TICKS)
cte("flagged", "ticks", """
SELECT *, list_has_any(conds, ['M','Q','9']) AS admin,
  NOT list_has_any(conds, ['I','W','4','7','T','U','Z','L','P','R','C','H','G','N','V']) AS ul,
  NOT list_has_any(conds, ['W','4','7','T','U','Z','L','P','R','C','H','G','N','V']) AS fl
FROM ticks""")
cte("trades", "flagged", "SELECT * FROM flagged WHERE NOT admin AND price > 0 AND size > 0")
cte("quotes", "", f"""
SELECT CASE event_type {PAIRS} END AS symbol, epoch_us(ts) // $D AS session,
  epoch_us(ts) AS ts_us, event_id AS seq,
  CASE WHEN value > 0 THEN round(100 + value / 100 - 0.25, 4) ELSE 0.0 END AS bid,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS bid_size,
  round(100 + value / 100 + 0.25, 4) AS ask, user_id % 100 + 1 AS ask_size
FROM events""")
cte("sided", "trades quotes", """
SELECT t.*, q.bid, q.ask, q.bid_size, q.ask_size,
  CASE WHEN NOT fl THEN 0 WHEN price >= ask THEN 1 WHEN price <= bid THEN -1
       WHEN price > (ask + bid) * 0.5 THEN 1 WHEN price < (ask + bid) * 0.5 THEN -1
       WHEN price > pf THEN 1 WHEN price < pf THEN -1 ELSE 0 END AS side
FROM (SELECT *, last_value(CASE WHEN fl THEN price END IGNORE NULLS) OVER (
        PARTITION BY symbol, session ORDER BY ts_us, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pf FROM trades) t
ASOF LEFT JOIN (SELECT * FROM quotes WHERE bid > 0 AND ask >= bid) q
  ON t.symbol = q.symbol AND t.session = q.session AND t.ts_us > q.ts_us""")


# ------------------------------------------------------------------ wire messages

_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"


def wire_documents(spark, sf_dir):
    """One JSON document per event: its trade, the paired quote, and a control record."""
    e = V.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    ts = F.concat(format_rfc3339(ntz_us(F.col("ts"))).substr(1, 26), F.lit("789-05:00"))
    trade = F.struct(
        F.lit("t").alias("T"), F.col("event_type").alias("S"), F.col("event_id").alias("i"),
        F.lit("V").alias("x"), F.col("value").alias("p"), k.alias("s"), ts.alias("t"),
        F.array(F.lit("@")).alias("c"), F.lit("C").alias("z"),
    )
    quote = F.struct(
        F.lit("q").alias("T"), F.col("event_type").alias("S"), F.col("value").alias("bp"),
        k.alias("bs"), (F.col("value") + 1).alias("ap"), k.alias("as"), ts.alias("t"),
    )
    control = F.struct(F.lit("error").alias("T"), (k % 9 + 400).cast("int").alias("code"))
    doc = F.concat(
        F.lit("["), F.to_json(trade), F.lit(","), F.to_json(quote), F.lit(","), F.to_json(control),
        F.lit("]"),
    )
    # a truncated document stands for a damaged message
    return e.select("event_id", F.when(k == 77, doc.substr(1, 40)).otherwise(doc).alias("raw"))


@query("parse_wire", "", f"""
SELECT event_id, 'trade' AS kind, event_type AS symbol, epoch_us(ts) + 18000000000 AS ts_us,
  value AS price, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS size, 1 AS codes
FROM events WHERE props NOT LIKE '%: 77}}'
UNION ALL
SELECT event_id, 'quote', event_type, epoch_us(ts) + 18000000000, value,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT), 0
FROM events WHERE props NOT LIKE '%: 77}}' AND value > 0""")
def parse_wire(spark, sf_dir):
    msgs = wire.messages(wire_documents(spark, sf_dir))
    t = wire.trades(msgs, ("event_id",)).select(
        "event_id", F.lit("trade").alias("kind"), "symbol", "ts_us", "price", "size",
        F.size("conditions").alias("codes"),
    )
    q = wire.quotes(msgs, ("event_id",)).select(
        "event_id", F.lit("quote").alias("kind"), "symbol", "ts_us", F.col("bid").alias("price"),
        F.col("bid_size").alias("size"), F.lit(0).alias("codes"),
    )
    return t.unionByName(q)


@query("route_errors", "", """
SELECT CASE WHEN k = 77 THEN NULL ELSE 400 + k % 9 END AS code,
  CASE WHEN k = 77 THEN 'quarantine' WHEN k % 9 IN (2) THEN 'fatal' WHEN k % 9 = 6 THEN 'retry'
       ELSE 'ignore' END AS route, count(*) AS messages
FROM (SELECT CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
GROUP BY ALL""")
def route_errors(spark, sf_dir):
    errs = wire.errors(wire.messages(wire_documents(spark, sf_dir)))
    return errs.groupBy(F.col("code").cast("bigint").alias("code"), "route").agg(
        F.count("*").alias("messages")
    )


@query("parse_ts", "", f"""
SELECT event_id, epoch_us(ts) + 18000000000 AS ts_us,
  strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS text FROM events""")
def parse_ts(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    text = F.concat(format_rfc3339(ntz_us(F.col("ts"))).substr(1, 26), F.lit("999-05:00"))
    us = parse_rfc3339_us(text)
    return e.select("event_id", us.alias("ts_us"), format_rfc3339(us).alias("text"))


# ------------------------------------------------------------------ scans and feeds


@query("scan_bars", "", """
SELECT l_suppkey AS symbol, epoch_us(l_shipdate) AS ts_us, max(l_extendedprice) AS high,
  min(l_extendedprice) AS low, CAST(sum(l_quantity) AS BIGINT) AS volume
FROM lineitem WHERE l_suppkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
  AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
GROUP BY ALL""")
def scan_bars(spark, sf_dir):
    start, end = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (1996, 1999))
    rows = T.scan_range(
        V.table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate",
        [1, 2, 3, 5, 8, 13, 21, 34, 55, 89], start, end,
    )
    return rows.groupBy(
        F.col("l_suppkey").alias("symbol"), ntz_us(F.col("l_shipdate")).alias("ts_us")
    ).agg(
        F.max("l_extendedprice").alias("high"),
        F.min("l_extendedprice").alias("low"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
    )


@query("scan_tape", "ticks", """
SELECT symbol, session, ts_us, seq, price, size FROM ticks
WHERE symbol IN ('click', 'view') AND ts_us >= open_us + 2 * $M AND ts_us < open_us + 12 * $M""")
def scan_tape(spark, sf_dir):
    m = P.macro_us
    rows = V.events_prints(spark, sf_dir)
    out = T.scan_range(
        rows, "symbol", "ts_us", ["click", "view"],
        F.col("open_us") + 2 * m, F.col("open_us") + 12 * m,
    )
    return out.select("symbol", "session", "ts_us", "seq", "price", "size")


@query("feed_fallback", "", """
SELECT o_custkey AS symbol, o_orderpriority AS feed, count(*) AS bars,
  max(o_totalprice) AS high
FROM (SELECT *, min(o_orderpriority) OVER (PARTITION BY o_custkey) AS best FROM orders)
WHERE o_orderpriority = best GROUP BY ALL""")
def feed_fallback(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    best = T.feed_fallback(orders, ["o_custkey"], F.col("o_orderpriority"))
    return best.groupBy(
        F.col("o_custkey").alias("symbol"), F.col("o_orderpriority").alias("feed")
    ).agg(F.count("*").alias("bars"), F.max("o_totalprice").alias("high"))


@query("feed_splice", "", """
SELECT o_orderkey AS bar_id, epoch_us(o_orderdate) AS ts_us, 'hist' AS feed
FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate < TIMESTAMP '1998-01-01'
UNION ALL
SELECT o_orderkey, epoch_us(o_orderdate), 'live'
FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '1998-01-01'""")
def feed_splice(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("bar_id"), ntz_us(F.col("o_orderdate")).alias("ts_us"),
        "o_orderdate", "o_orderstatus",
    )
    hist = rows.filter("o_orderstatus <> 'P'").withColumn("feed", F.lit("hist"))
    live = rows.filter("o_orderstatus <> 'F'").withColumn("feed", F.lit("live"))
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return T.feed_splice(hist, live, "o_orderdate", cut).select("bar_id", "ts_us", "feed")


@query("merge_tape", "trades quotes", """
SELECT symbol, session, n, first_src, last_src, trades, quotes FROM (
  SELECT symbol, session, count(*) AS n, count(*) FILTER (src = 'trade') AS trades,
    count(*) FILTER (src = 'quote') AS quotes,
    arg_min(src, ts_us * 4 + prio) AS first_src, arg_max(src, ts_us * 4 + prio) AS last_src
  FROM (SELECT symbol, session, ts_us, 'trade' AS src, 0 AS prio FROM trades
        UNION ALL SELECT symbol, session, ts_us, 'quote', 1 FROM quotes)
  GROUP BY symbol, session)""")
def merge_tape(spark, sf_dir):
    t = I.clean(V.events_prints(spark, sf_dir))
    context = t.filter(F.col("symbol").isin(V.MARKET, V.FEAR))
    tape_ = I.merge_tape(t, V.events_quotes(spark, sf_dir), context)
    order = F.struct("ts_us", "src_prio", "seq")
    return tape_.groupBy("symbol", "session").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("src") == "trade").alias("trades"),
        F.count_if(F.col("src") == "quote").alias("quotes"),
        F.min_by("src", order).alias("first_src"),
        F.max_by("src", order).alias("last_src"),
    )


# ------------------------------------------------------------------ filters


@query("classify_conditions", "flagged", """
SELECT seq, admin, ul AS updates_last, true AS updates_volume, fl AS flow_eligible
FROM flagged""")
def classify_conditions(spark, sf_dir):
    return I.with_condition_flags(V.events_prints(spark, sf_dir)).select(
        "seq", "admin", "updates_last", "updates_volume", "flow_eligible"
    )


@query("drop_bad", "ticks", "SELECT seq, price, size FROM ticks WHERE price > 0 AND size > 0")
def drop_bad(spark, sf_dir):
    return I.drop_bad(V.events_prints(spark, sf_dir)).select("seq", "price", "size")


cte("late", "trades", """
SELECT *, coalesce(ts_us < wm - 6 * $U, false) AS late FROM (
  SELECT *, max(ts_us) OVER (PARTITION BY symbol ORDER BY arr_us, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM trades)""")


@query("late_demote", "late", """
SELECT seq, wm AS watermark_us, late, ul AND NOT late AS updates_last,
  fl AND NOT late AS flow_eligible FROM late""")
def late_demote(spark, sf_dir):
    return I.late_demote(I.clean(V.events_prints(spark, sf_dir)), P).select(
        "seq", "watermark_us", "late", "updates_last", "flow_eligible"
    )


@query("filter_stats", "flagged late", """
SELECT symbol, count(*) AS prints, count(*) FILTER (NOT (price > 0 AND size > 0))
  AS dropped_bad_fields, count(*) FILTER (price > 0 AND size > 0 AND admin) AS admin_excluded,
  (SELECT count(*) FROM late l WHERE l.symbol = f.symbol AND l.late) AS late_out_of_sequence
FROM flagged f GROUP BY symbol""")
def filter_stats(spark, sf_dir):
    return I.filter_stats(V.events_prints(spark, sf_dir), P)


@query("order_guard", "ticks", """
SELECT seq, session, ts_us, max_seen_us FROM (
  SELECT *, max(ts_us) OVER (PARTITION BY session ORDER BY arr_us, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_seen_us FROM ticks)
WHERE ts_us < max_seen_us - 8 * $U""")
def order_guard(spark, sf_dir):
    return I.order_violations(V.events_prints(spark, sf_dir), P).select(
        "seq", "session", "ts_us", "max_seen_us"
    )


cte("live", "ticks", "SELECT * FROM ticks WHERE size >= 60")
cte("gaps", "live", """
SELECT session, ts_us AS g1, lag(ts_us) OVER (PARTITION BY session ORDER BY ts_us, seq) AS g0
FROM live QUALIFY g1 - g0 > 3 * $U""")

@query("gap_backfill", "ticks live gaps", """
SELECT seq, symbol, exchange, min(b) AS is_backfill FROM (
  SELECT seq, symbol, exchange, false AS b FROM live
  UNION ALL SELECT t.seq, t.symbol, t.exchange, true FROM ticks t JOIN gaps g
    ON t.session = g.session AND t.ts_us BETWEEN g.g0 AND g.g1)
GROUP BY ALL""")
def gap_backfill(spark, sf_dir):
    rows = V.events_prints(spark, sf_dir)
    live = rows.filter(F.col("size") >= 60)  # the feed that arrived; the rest is history only
    return I.gap_backfill(live, rows, P).select("seq", "symbol", "exchange", "is_backfill")



cte("lagged", "ticks", """
SELECT session, arr_us // $U * $U AS b_us, count(*) AS prints, max(arr_us) AS last_arr,
  sum(arr_us - ts_us)::DOUBLE / count(*) / $U AS lag_units
FROM ticks GROUP BY ALL""")


@query("feed_health", "lagged", """
SELECT session, b_us, prints, round(latency + 1e-9, 6) AS latency, round(silence, 6) AS silence,
  latency <= 5.0 AND silence <= 3.0 AS alerts_enabled
FROM (SELECT *, list_reduce(list(lag_units) OVER w, lambda a, x: a + 0.1::DOUBLE * (x - a))
        AS latency,
      coalesce((b_us - lag(last_arr) OVER w)::DOUBLE / $U, 0.0) AS silence
      FROM lagged WINDOW w AS (PARTITION BY session ORDER BY b_us))""")
def feed_health(spark, sf_dir):
    return I.feed_health(V.events_prints(spark, sf_dir), P).select(
        "session", "b_us", "prints", r(F.col("latency") + 1e-9).alias("latency"),
        r(F.col("silence")).alias("silence"), "alerts_enabled",
    )


@query("universe", "", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
  SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE upper(trim(r_name)) IN ('ASIA', 'EUROPE'))""")
def universe(spark, sf_dir):
    wanted = [s.strip().upper() for s in "asia, europe".split(",")]
    region = V.table(spark, sf_dir, "region").filter(F.upper(F.trim("r_name")).isin(wanted))
    nation = V.table(spark, sf_dir, "nation").join(
        region, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi"
    )
    cust = V.table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi"
    )
    listed = cust.select(F.col("c_custkey").alias("o_custkey"))
    return T.in_universe(V.table(spark, sf_dir, "orders"), listed, "o_custkey").select(
        "o_orderkey", "o_custkey"
    )


@query("in_session", "ticks", """
SELECT seq, session FROM ticks WHERE ts_us >= open_us AND ts_us < close_us""")
def in_session(spark, sf_dir):
    rows = V.events_prints(spark, sf_dir)
    return S.rows_in_session(rows, V.events_sessions(spark, sf_dir), "UTC").select("seq", "session")


@query("session_for", "ticks", """
SELECT seq, CASE WHEN ts_us BETWEEN open_us - 4 * 3600000000 AND close_us THEN session END
  AS found_session FROM ticks""")
def session_for(spark, sf_dir):
    rows = V.events_prints(spark, sf_dir)
    found = S.session_for(rows, V.events_sessions(spark, sf_dir), P, "UTC")
    return found.select("seq", "found_session")


# ------------------------------------------------------------------ quotes and sides


@query("asof_quote", "sided", "SELECT seq, symbol, ts_us, bid, bid_size, ask, ask_size FROM sided")
def asof_quote(spark, sf_dir):
    rows = sides.asof_quote(
        I.clean(V.events_prints(spark, sf_dir)), V.events_quotes(spark, sf_dir), P
    )
    return rows.select("seq", "symbol", "ts_us", "quote.*")


@query("side_class", "sided", "SELECT seq, symbol, ts_us, price, side FROM sided")
def side_class(spark, sf_dir):
    return tape(spark, sf_dir).sided.select("seq", "symbol", "ts_us", "price", "side")

