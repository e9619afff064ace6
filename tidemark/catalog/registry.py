"""All registered queries (importing the area modules registers them)."""

from . import bars, health, ingest, levels, signals, warm  # noqa: F401
from .base import ORACLES, QUERIES, compose

__all__ = ["QUERIES", "oracles"]


def oracles() -> dict[str, str]:
    return {name: compose(needs, sql, swap=swap) for name, (needs, sql, swap) in ORACLES.items()}
