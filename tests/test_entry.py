"""The registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck
from tidemark.catalog import registry

SF = "/root/testdata/sf0.001"
SAMPLE = ("parse_wire", "late_demote", "gap_backfill", "micro_bars", "session_vwap",
          "merge_levels", "gate_reason", "signals", "perf_slices", "outbox",
          "gate_timeline", "signals_gated", "health_changes", "candidates_alertable")


def test_every_oracle_belongs_to_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(registry.QUERIES) > 110
    # the training-data queries have a test of their own, and may be absent
    assert set(registry.QUERIES) - set(oracles) == {"walkforward_scores"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    ok, message, _ = compare(
        spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF
    )
    assert ok, message


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
