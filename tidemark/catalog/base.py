"""Registration of queries, shared SQL building blocks and the shared events tape."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..operators.ingest import gap_backfill, health_changes
from ..operators.warmup import WarmUp
from ..plans.pipeline import Tape
from ..profile import DAY_US
from ..sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, tuple[str, str, dict]] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}
_TAPES: dict[tuple, Tape] = {}

P = V.EVENTS_PROFILE
NUM = {
    "U": P.unit_us,
    "M": P.macro_us,
    "D": DAY_US,
    "O": V.EVENTS_OPEN_US,
    "VIS": P.visibility_us,
}


def tape(spark: SparkSession, sf_dir: str) -> Tape:
    """The events tape of one session and folder; stage tables are written once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TAPES:
        _TAPES[key] = Tape(
            V.events_prints(spark, sf_dir),
            V.events_quotes(spark, sf_dir),
            V.events_sessions(spark, sf_dir),
            P,
            V.MARKET,
            V.FEAR,
        )
    return _TAPES[key]


def warm_tape(spark: SparkSession, sf_dir: str) -> Tape:
    """The events tape with every session starting late, warmed up from historical bars."""
    key = (spark.sparkContext.applicationId, sf_dir, "warm")
    if key not in _TAPES:
        sessions = V.events_sessions(spark, sf_dir)
        starts = V.events_starts(sessions)
        prints = V.events_prints(spark, sf_dir).join(starts, "session").filter("ts_us >= start_us").drop("start_us")
        minutes, days = (V.events_hist(spark, sf_dir, width) for width in (P.macro_us, DAY_US))
        warm = WarmUp(minutes, days, starts, zone="UTC")
        _TAPES[key] = Tape(prints, V.events_quotes(spark, sf_dir), sessions, P, V.MARKET, V.FEAR, warm=warm)
    return _TAPES[key]


OUTAGE_US = (720 * 60_000_000, 870 * 60_000_000)  # of the day, in which the live feed is down
HEALTH = replace(P, feed_latency_max=3.6)


def outage_tape(spark: SparkSession, sf_dir: str) -> Tape:
    """The events tape as a feed with an outage saw it: larger prints never arrived, and what
    the gaps lack was fetched later.  Feed health is that of the live prints."""
    key = (spark.sparkContext.applicationId, sf_dir, "outage")
    if key not in _TAPES:
        rows = V.events_prints(spark, sf_dir)
        day = F.col("ts_us") % DAY_US
        live = rows.filter((F.col("size") <= 70) & ~((day >= OUTAGE_US[0]) & (day < OUTAGE_US[1])))
        changes = durable(health_changes(live, HEALTH), "health")
        _TAPES[key] = Tape(
            gap_backfill(live, rows, P), V.events_quotes(spark, sf_dir), V.events_sessions(spark, sf_dir),
            P, V.MARKET, V.FEAR, health=changes,
        )
    return _TAPES[key]


def cte(name: str, needs: str, body: str) -> None:
    """Define a named SQL block; ``$U`` and friends become grid constants."""
    if name in CTES:
        raise ValueError(f"block {name} is defined twice")
    CTES[name] = (tuple(needs.split()), fill(body))


def fill(text: str) -> str:
    for k in sorted(NUM, key=len, reverse=True):
        text = text.replace(f"${k}", f"{NUM[k]}::BIGINT")
    # @name@ stands for a profile parameter
    return re.sub(r"@(\w+)@", lambda m: f"{float(getattr(P, m[1]))!r}::DOUBLE", text)


def compose(needs: str, final: str, recursive: bool = False, swap: dict[str, str] | None = None) -> str:
    """``WITH`` all needed blocks (in dependency order) plus the final statement.  ``swap`` names
    blocks that take the place of others."""
    done: list[str] = []
    blocks_of = CTES | {old: ((new,), f"SELECT * FROM {new}") for old, new in (swap or {}).items()}

    def visit(n: str) -> None:
        for m in blocks_of[n][0]:
            visit(m)
        if n not in done:
            done.append(n)

    for n in needs.split():
        visit(n)
    if not done:
        return fill(final)
    blocks = []
    for n in done:
        body = blocks_of[n][1]
        if body.startswith("RECURSIVE"):
            recursive = True
            blocks.append(f"{n} AS ({body[len('RECURSIVE') :]})")
        else:
            blocks.append(f"{n} AS MATERIALIZED ({body})")
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(blocks) + "\n" + fill(final)


def query(name: str, needs: str = "", sql: str | None = None, swap: dict[str, str] | None = None):
    """Register the decorated function and its oracle."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = (needs, sql, swap or {})
        return fn

    return register
