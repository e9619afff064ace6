"""Headline queries timed on the driver tables; prints one JSON line.

The events queries share stage tables.  ``pipeline`` times building all of them from
the raw tables, so that cost is in the total once and not hidden."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "parse_wire", "late_demote", "gap_backfill", "merge_tape", "asof_quote", "micro_bars",
    "macro_bars", "rolling_flow", "session_vwap", "minute_baseline", "context_features",
    "persistence", "merge_levels", "sweep_reclaim", "active_reclaims", "snapshots",
    "gate_reason", "trend_onset", "resolution", "label_outcome", "signals", "flow_leaders",
    "signal_upsert", "daily_metrics", "perf_slices", "efficacy", "outbox", "online_zscore",
)


def lineitem_flow(spark, sf_dir):
    """Rolling one-sided flow over the line-item tape (600,000 prints at sf0.1)."""
    from pyspark.sql import functions as F

    from tidemark.operators import bars as B
    from tidemark.sources import views as V

    p = V.LINEITEM_PROFILE
    tape = V.lineitem_tape(spark, sf_dir)
    filled = B.gap_fill(B.micro_bars(tape, p), p)
    rows = B.print_windows(tape, B.with_bar_windows(filled, (5, 15, 60)), p)
    return rows.groupBy("symbol").agg(
        F.count("*").alias("prints"), F.sum("v60").alias("v60"), F.max("hi15").alias("hi15")
    )


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemark.catalog import base, registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    out: dict[str, float] = {}

    def timed(name, fn) -> None:
        t0 = time.time()
        fn().write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - t0, 3)

    def pipeline():
        t = base.tape(spark, sf_dir)
        _ = t.flow, t.reclaims
        return t.evaluated

    timed("pipeline", pipeline)
    for name in HEADLINE:
        timed(name, lambda n=name: registry.QUERIES[n](spark, sf_dir))
    timed("lineitem_flow", lambda: lineitem_flow(spark, sf_dir))
    total = round(sum(out.values()), 3)
    print(
        json.dumps(
            {"metric": "total_seconds", "value": total, "unit": "sec", "queries": out,
             "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
