"""All queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import decontaminate, divergence, language_id, line_dedup, merkle, mixing, near_dedup, quality_rules, substring_dedup, suffix_lm, toxicity, warc, wrappers

_MODULES = (decontaminate, divergence, language_id, line_dedup, merkle, mixing, near_dedup, quality_rules, substring_dedup, suffix_lm, toxicity, warc, wrappers)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
