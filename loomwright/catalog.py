"""All registered queries of the library and their DuckDB oracles."""

from __future__ import annotations

from .plans import q_answers, q_chat, q_dedup, q_extras, q_io, q_records, q_report, q_score  # noqa: F401  (each registers its queries)
from .plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
