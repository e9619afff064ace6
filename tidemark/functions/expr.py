"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def bps(new: Column, old: Column) -> Column:
    """Move from ``old`` to ``new`` in basis points; null when ``old`` is not positive."""
    return F.when(old > 0, (new - old) / old * 1e4)


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """``num / den`` when ``den`` is positive, else ``default``."""
    out = F.when(den > 0, num / den)
    return out if default is None else F.coalesce(out, F.lit(default))


def floor_us(ts_us: Column, width_us: int) -> Column:
    """Start of the ``width_us`` bucket that holds ``ts_us``."""
    return ts_us - F.pmod(ts_us, F.lit(width_us))


def r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def r_many(x: Column, digits: int = 6) -> Column:
    """``r`` of a double for very many rows: half-up on its decimal form, which is spelt out only near a tie.

    Elsewhere the nearest whole number of the scaled value decides; dividing it (below 2^53) by a
    power of ten gives the double nearest to that decimal, as parsing it would."""
    scale = float(10**digits)
    y = x * scale
    whole = F.floor(y)
    past = y - whole
    clear = (F.abs(y) < 1e9) & (F.abs(past - 0.5) > 1e-3)
    return F.when(clear, (whole + F.when(past > 0.5, 1).otherwise(0)) / scale).otherwise(F.round(x, digits))


def order_key(major: Column, minor: Column) -> Column:
    """Two BIGINT order columns as one number, sorted by ``major`` then ``minor``.

    ``min_by``/``max_by`` over a number run in a hash aggregate; over a struct Spark
    would have to sort all rows before combining them."""
    step = F.lit(str(1 << 64)).cast("decimal(20,0)")
    unsigned = minor.cast("decimal(19,0)") + F.lit(str(1 << 63)).cast("decimal(19,0)")
    return major.cast("decimal(17,0)") * step + unsigned
