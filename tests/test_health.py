"""Feed health as change points, and what may start a candidate."""

from __future__ import annotations

import random
from dataclasses import replace

from pyspark.sql import functions as F

from tidemark import DEFAULT
from tidemark.operators import ingest

SEC = DEFAULT.unit_us
P = replace(DEFAULT, feed_latency_max=2.0, feed_silence=3.0, feed_alpha=0.5)


def feed(spark, rows):
    return spark.createDataFrame(rows, "session bigint, seq bigint, ts_us bigint, arr_us bigint")


def plain(rows, p, at):
    """Whether alerts are on for an instant, from the arrivals before it alone."""
    seen = [r for r in rows if r[3] <= at]
    if not seen:
        return True
    if at - max(r[3] for r in seen) > p.us(p.feed_silence):
        return False
    units = {}
    for r in rows:
        units.setdefault(r[3] // p.unit_us, []).append((r[3] - r[2]) / p.unit_us)
    average = None
    for u in sorted(units):
        if (u + 1) * p.unit_us <= at:
            x = sum(units[u]) / len(units[u])
            average = x if average is None else average + p.feed_alpha * (x - average)
    return average is None or average <= p.feed_latency_max


def test_changes_follow_the_arrivals(spark):
    rng, rows, t = random.Random(4), [], 1000 * SEC
    for i in range(300):
        t += rng.choice([1, SEC // 3, SEC, 3 * SEC, 3 * SEC + 1, 6 * SEC] if i % 9 == 0 else [1, SEC // 5, SEC // 2])
        rows.append((7, i, t - rng.choice([0, SEC, 5 * SEC]) * (1 + (i // 60) % 2), t))
    changes = ingest.health_changes(feed(spark, rows), P).cache()
    kinds = {r.cause for r in changes.collect()}
    assert kinds == {None, "latency", "silence"}
    asked = sorted({r[3] + d for r in rows for d in (-1, 0, 1, 3 * SEC, 3 * SEC + 1)} | {0, t + 100 * SEC})
    ask = spark.createDataFrame([(7, x) for x in asked], "session bigint, at bigint")
    got = {r["at"] for r in ingest.alertable(ask, changes, P, "at").collect()}
    assert got == {x for x in asked if plain(rows, P, x)} and 0 < len(got) < len(asked)


def test_other_sessions_missing_instants_and_no_changes(spark):
    rows = [(1, 0, 0, 0), (1, 1, 0, 50 * SEC)]
    changes = ingest.health_changes(feed(spark, rows), P)
    ask = spark.createDataFrame([(1, 10 * SEC, "a"), (1, 10 * SEC, "a"), (1, None, "b"), (2, 10 * SEC, "c"), (1, 2 * SEC, "d")], "session bigint, arr_us bigint, cause string")
    assert sorted(r.cause for r in ingest.alertable(ask, changes, P).collect()) == ["b", "c", "d"]
    assert ingest.alertable(ask, changes.limit(0), P).count() == 5
    assert ingest.health_changes(feed(spark, rows).filter(F.lit(False)), P).count() == 0
