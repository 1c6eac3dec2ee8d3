"""All registered queries of the engine and their DuckDB twins."""

from __future__ import annotations

from corpuskiln.plans import queries_codecs, queries_corpus, queries_matrix, queries_results  # noqa: F401
from corpuskiln.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
