"""Vendor wire messages: JSON arrays of trades, quotes and control records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import parse_rfc3339_us

# Keys that differ only in case (T/t, S/s) rule out a struct schema: read maps.
DOCUMENT = "array<map<string,string>>"
UNREADABLE = "unreadable"
# Error codes that must stop the feed, and the one worth a retry.
FATAL_CODES = (402, 409)
RETRY_CODES = (406,)


def messages(raw: DataFrame, column: str = "raw") -> DataFrame:
    """One row per message; an unreadable document gives one row with ``bad`` true.

    Works unchanged on a streaming ``raw``."""
    parsed = F.from_json(F.col(column), DOCUMENT, {"mode": "PERMISSIVE"})
    # a stand-in record marks what could not be read, so each document is parsed once
    damaged = F.array(F.create_map(F.lit("T"), F.lit(UNREADABLE)))
    rows = raw.withColumn("m", F.explode(F.coalesce(parsed, damaged)))
    return rows.withColumn("bad", F.col("m")["T"] == UNREADABLE)


def trades(msgs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    m = F.col("m")
    none = F.array().cast("array<string>")
    return msgs.filter(m["T"] == "t").select(
        *keep,
        m["S"].alias("symbol"),
        parse_rfc3339_us(m["t"]).alias("ts_us"),
        m["p"].try_cast("double").alias("price"),
        m["s"].try_cast("bigint").alias("size"),
        F.coalesce(F.from_json(m["c"], "array<string>"), none).alias("conditions"),
        m["x"].alias("exchange"),
        m["z"].alias("tape"),
        m["i"].try_cast("bigint").alias("trade_id"),
    )


def quotes(msgs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Quotes; those without a bid or ask carry no information and are skipped."""
    m = F.col("m")
    bid, ask = m["bp"].try_cast("double"), m["ap"].try_cast("double")
    return msgs.filter((m["T"] == "q") & (bid > 0) & (ask > 0)).select(
        *keep,
        m["S"].alias("symbol"),
        parse_rfc3339_us(m["t"]).alias("ts_us"),
        bid.alias("bid"),
        m["bs"].try_cast("bigint").alias("bid_size"),
        ask.alias("ask"),
        m["as"].try_cast("bigint").alias("ask_size"),
    )


def error_route(code: Column) -> Column:
    return (
        F.when(code.isin(*FATAL_CODES), "fatal")
        .when(code.isin(*RETRY_CODES), "retry")
        .otherwise("ignore")
    )


def errors(msgs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Error records and unreadable documents with what to do about them."""
    m = F.col("m")
    code = m["code"].try_cast("int")
    return msgs.filter(F.col("bad") | (m["T"] == "error")).select(
        *keep,
        code.alias("code"),
        F.when(F.col("bad"), "quarantine").otherwise(error_route(code)).alias("route"),
    )
