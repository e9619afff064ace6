"""Intraday tape analytics as composable ``DataFrame -> DataFrame`` operators."""

from .profile import DEFAULT, TUNED, Profile

__all__ = ["DEFAULT", "TUNED", "Profile"]
