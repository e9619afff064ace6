"""From finished candidates to signals: inputs of the fold, its result, busy intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp
from ..operators import arbiter, decide, gates, resolve
from ..operators.metrics import tod_bucket
from .pipeline import KEY, Tape

ID = [*KEY, "ts_us", "seq", "pref"]
TREND_PREF = 1_000_000_000  # a tick's trend candidate comes after the prints before it
COMMON = [
    *ID, "direction", "price", "level_price", "level_kind", "trigger_verb", "invalidation",
    "minute_frac", "vol_ratio_prev", "score", "penalty", "comp_active", "is_trend", "mkt_al_5m",
    "fear_5m", "open_us", "close_us",
]


def contenders(t: Tape) -> DataFrame:
    """Everything that could become a signal under the loosest adaptive multipliers.

    Breakouts are prefiltered with the lower multiplier bound; the fold rechecks them
    with the multipliers of their moment.  Trend onsets bypass the micro gates."""
    p = t.profile
    burst = t.promising.filter("loose").withColumn("is_trend", F.lit(False))
    frac = clamp(F.col("idx") / float(p.session_macros), 0.0, 1.0)
    trends = t.trends.select(
        *KEY,
        "ts_us",
        F.lit(0).cast("bigint").alias("seq"),
        F.lit(TREND_PREF).cast("bigint").alias("pref"),
        "direction", "price", "level_price", "level_kind", "range5m_bps", "comp_active",
        "open_us", "close_us",
        F.col("vol_ratio").alias("vol_ratio_prev"),
        (F.col("mkt_5m") * F.col("direction")).alias("mkt_al_5m"),
        "fear_5m",
        F.lit("trend").alias("trigger_verb"),
        F.lit(0.0).alias("score"),
        F.lit(0.0).alias("penalty"),
        F.lit(True).alias("is_trend"),
        frac.alias("minute_frac"),
    ).withColumn("invalidation", gates.invalidation(gates.risk_bps(p)))
    return burst.select(*COMMON).unionByName(trends.select(*COMMON))


def finished(t: Tape, run_id: str = "run") -> DataFrame:
    """Contenders with verdict, label and time-of-day bucket: the fold's input."""
    p = t.profile
    rows = t.stage(contenders(t), "contenders")
    verdicts = resolve.resolve(rows, t.observations, t.filled, p, t.stage)
    labels = resolve.label_outcomes(rows, t.filled, p)
    out = rows.join(verdicts, ID, "left").join(labels, ID, "left")
    none = F.lit(None).cast("double")
    return out.withColumns(
        {
            "run_id": F.lit(run_id),
            "bucket": tod_bucket(F.col("ts_us"), F.col("open_us"), F.col("close_us")),
            "prob": none,
            "efficacy_prob": none,
        }
    )


def with_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """``finished`` rows with the models' probabilities (``prob``, ``efficacy_prob``) from a table
    of scores by candidate (``ID``; with ``run_id`` where runs differ).  A candidate without a
    score keeps a null and is never suppressed for it; of repeated scores the lowest counts."""
    key = [c for c in ("run_id", *ID) if c in scores.columns]
    one = scores.groupBy(*key).agg(F.min("prob").alias("prob"), F.min("efficacy_prob").alias("efficacy_prob"))
    return rows.drop("prob", "efficacy_prob").join(one, key, "left")


def signals(t: Tape, rows: DataFrame, **options) -> DataFrame:
    """Accepted rows with their signal id; ``options`` go to the arbitration.

    Sessions are decided symbol by symbol; only those whose symbols share more than time are
    folded in sequence (see ``operators.decide``)."""
    if options.pop("scope", "session") == "symbol":
        verdict = arbiter.arbitrate(rows, t.profile, scope="symbol", **options)
    else:
        verdict = decide.arbitrate(rows, t.profile, verdicts=False, stage=t.stage, **options)
    won = verdict.filter(F.col("verdict").isin("SIGNAL", "SUPPRESSED")).select(
        "run_id", *ID, "verdict", "vol_mult", "score_mult"
    )
    won = t.stage(won, "decided")  # a few rows, of known size when they meet all candidates
    out = won.join(rows, ["run_id", *ID])
    return out.withColumn("suppressed", F.col("verdict") == "SUPPRESSED").withColumn(
        "signal_id", gates.signal_id(F.col("symbol"), F.col("ts_us"), F.col("direction"))
    )


def looked_at(t: Tape, rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """Rows (symbol, session, ts_us, seq, pref, direction, level_price, ...) that the latest signal
    before them did not make the symbol ignore: no cooldown, no re-arming on the same structure."""
    p = t.profile
    run = F.lit("run").alias("run_id")
    won = sigs.select(
        run, *ID, F.when(F.col("level_price") > 0, F.col("direction")).alias("a_dir"),
        F.when(F.col("level_price") > 0, F.col("level_price")).alias("a_level"),
        decide.free_us(p, F.col("suppressed")).alias("a_deaf_us"),
        *[F.lit(None).cast("long").alias(c) for c in ("a_gap_us", "a_alerts", "a_trends")],
    )
    seen = decide.after_latest(rows.select(run, "*"), won, p)
    return seen.filter(decide.ignored(p).isNull()).select(*rows.columns)


def effective_rejections(t: Tape, rows: DataFrame, sigs: DataFrame, **options) -> DataFrame:
    """Rejection counts per symbol and reason, of candidates that were looked at only.

    Gates count by the rows that failed them, caps by the decisions themselves (``rows`` is the
    arbitration's input, ``sigs`` its result).  Exact while multipliers are one; where they have
    moved, the gates count by their fixed limits."""
    failed = t.evaluated.filter("gate_reason is not null and gate_reason <> 'untriggered'")
    failed = t.stage(failed.select(*ID, "direction", "level_price", "gate_reason"), "failed")
    failed = looked_at(t, failed, sigs)
    told = decide.arbitrate(rows, t.profile, stage=t.stage, **options)
    capped = told.filter(F.col("verdict").isin("trend_day_cap", "symbol_day_cap", "global_hour_cap"))
    both = failed.select("symbol", F.col("gate_reason").alias("reason")).union(capped.select("symbol", "verdict"))
    return both.groupBy("symbol", "reason").agg(F.count("*").alias("rejections"))
