"""All queries of the library and their DuckDB twins, gathered by name."""

from __future__ import annotations

from .plans import calculators, etl, extra, more, retrieval, rules, streams, usage  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "R2_bm25_topk"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
