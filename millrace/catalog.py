"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from .plans import evaluation_queries, provider_queries, question_queries, retrieval_queries, search_queries, source_queries, text_queries  # noqa: F401  register their queries
from .plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
