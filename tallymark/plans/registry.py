"""All registered queries and their SQL."""

from __future__ import annotations

from . import run_queries  # noqa: F401  registers its own
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
