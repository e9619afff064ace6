"""Literal tapes and a slow, sequential restatement of the rules to compare with."""

from __future__ import annotations

T0 = 1_756_000_020 * 1_000_000  # a fixed instant, in microseconds
SEC = 1_000_000

PRINT = (
    "symbol string, session bigint, ts_us bigint, seq bigint, price double, size bigint, "
    "side int, updates_last boolean, updates_volume boolean, flow_eligible boolean, "
    "open_us bigint, close_us bigint"
)
RAW = (
    "symbol string, session bigint, ts_us bigint, seq bigint, price double, size bigint, "
    "conditions array<string>, arr_us bigint, open_us bigint, close_us bigint"
)
QUOTE = (
    "symbol string, session bigint, ts_us bigint, seq bigint, bid double, bid_size bigint, "
    "ask double, ask_size bigint"
)


def prints(spark, rows, open_us=0, close_us=10**18):
    """rows: (seconds after T0, price, size[, side[, last, volume, flow]])."""
    out = []
    for i, row in enumerate(rows):
        at, price, size, *rest = row
        side = rest[0] if rest else 0
        last, vol, flow = rest[1:4] if len(rest) > 1 else (True, True, True)
        out.append(
            ("X", 1, T0 + round(at * SEC), i, float(price), size, side, last, vol, flow, open_us,
             close_us)
        )
    return spark.createDataFrame(out, PRINT)


def raw(spark, rows):
    """rows: (seconds, price, size, conditions[, arrival seconds])."""
    out = []
    for i, (at, price, size, conds, *arr) in enumerate(rows):
        ts = T0 + round(at * SEC)
        arrived = T0 + round(arr[0] * SEC) if arr else T0 + i
        out.append(("X", 1, ts, i, float(price), size, list(conds), arrived, 0, 10**18))
    return spark.createDataFrame(out, RAW)


def macro(spark, rows, start=None):
    """rows: (high, low[, close]) one per minute."""
    start = start if start is not None else T0 // (60 * SEC) * 60 * SEC
    out = []
    for i, (h, lo, *c) in enumerate(rows):
        m = start + i * 60 * SEC
        close = c[0] if c else (h + lo) / 2
        out.append(("X", 1, m, close, float(h), float(lo), float(close), 100, 1, 1, 0, 10**18,
                    m + 61 * SEC))
    return spark.createDataFrame(
        out,
        "symbol string, session bigint, m_us bigint, open double, high double, low double, "
        "close double, vol bigint, n bigint, traded_units bigint, open_us bigint, "
        "close_us bigint, eff_us bigint",
    )
