"""All queries of the package: importing this module registers them."""

from __future__ import annotations

from saltmarsh.plans import corpus_queries, governance_queries, measure_queries, preference_queries, report_queries, selection_queries, stream_queries, text_queries, vector_queries  # noqa: F401
from saltmarsh.plans.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
