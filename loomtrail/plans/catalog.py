"""Every registered query, and the SQL that gives the same rows."""

from __future__ import annotations

from . import q_compare, q_distances, q_learn, q_more, q_records, q_sequences, q_statistics, q_text  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
