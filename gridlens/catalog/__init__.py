"""All registered queries (Spark) and their DuckDB oracles."""

from __future__ import annotations

from . import registry
from . import q_series, q_features, q_profile, q_checks, q_text, q_models, q_io, q_more  # noqa: F401  (registers)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLE)
