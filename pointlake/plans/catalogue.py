"""All registered queries outside the training-data subpackage, with their DuckDB SQL."""

from __future__ import annotations

from . import q_io, q_metrics, q_relations, q_rules, q_selection, q_streams, q_text  # noqa: F401
from .registry import FOUND, Query


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in FOUND.items() if s}
