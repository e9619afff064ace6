"""Which of this subpackage's queries are registered, and which have SQL."""

from __future__ import annotations

import __spark_entry__ as entry
from tidemark.llm import catalog

#: Random draws, trained models, crc32 with letters of any script, and trees: tested against brute force.
WITHOUT_SQL = {"op2_mixing", "op6_wrappers", "op9_toxicity", "op10_suffix_lm", "op11_language_id"}


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == WITHOUT_SQL
    assert set(catalog.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(catalog.ORACLES) <= set(entry.oracle_sql())
