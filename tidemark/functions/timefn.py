"""Time conversions.  Operators carry time as epoch microseconds (BIGINT), which
keeps window arithmetic exact and independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz_us(ts: Column) -> Column:
    """Epoch microseconds of a TIMESTAMP_NTZ column read as UTC wall time."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))


def us_ntz(ts_us: Column) -> Column:
    """Epoch microseconds as TIMESTAMP_NTZ in UTC wall time."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", ts_us, epoch)


def parse_rfc3339_us(text: Column) -> Column:
    """RFC-3339 text (any offset, up to nanoseconds) to epoch microseconds.

    Digits beyond the microsecond are cut off, not rounded; bad text gives null."""
    return F.unix_micros(text.try_cast("timestamp"))


def format_rfc3339(ts_us: Column) -> Column:
    """Epoch microseconds to ``YYYY-MM-DDTHH:MM:SS.ffffffZ`` in UTC."""
    base = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_us / 86_400_000_000).cast("int"))
    sec = F.pmod(F.floor(ts_us / 1_000_000), F.lit(86_400))
    text = F.format_string(
        "%sT%02d:%02d:%02d.%06dZ",
        base.cast("string"),
        F.floor(sec / 3600),
        F.floor(sec / 60) % 60,
        sec % 60,
        F.pmod(ts_us, F.lit(1_000_000)),
    )
    return F.when(ts_us.isNotNull(), text)


def wall_to_utc_us(date_text: Column, clock_text: Column, zone: str) -> Column:
    """Local ``YYYY-MM-DD`` + ``HH:MM`` in ``zone`` to epoch microseconds (DST safe)."""
    wall = F.concat(date_text, F.lit(" "), clock_text, F.lit(":00"))
    local = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall.cast("timestamp_ntz"))
    return ntz_us(local)


def local_day(ts_us: Column, zone: str) -> Column:
    """Day number (days since 1970-01-01) of the instant in ``zone``."""
    if zone == "UTC":
        return F.floor(ts_us / 86_400_000_000)
    wall = F.convert_timezone(F.lit("UTC"), F.lit(zone), us_ntz(ts_us))
    return F.floor(ntz_us(wall) / 86_400_000_000)


def local_clock(ts_us: Column, zone: str) -> Column:
    """``HH:MM:SS`` of the instant in ``zone``."""
    wall = F.convert_timezone(F.lit("UTC"), F.lit(zone), us_ntz(ts_us))
    return F.date_format(wall, "HH:mm:ss")
