"""Queries: operators bound to concrete tables, each with its SQL counterpart where SQL can say it."""

from marginalia.plans import (  # noqa: F401  (imports register queries)
    chunk_queries, evidence_queries, report_queries, retrieval_queries, source_queries, stream_queries, text_queries,
)
from marginalia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
