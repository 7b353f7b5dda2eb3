"""All queries of the engine, by name, with the DuckDB SQL that each equals."""

from __future__ import annotations

from lumenlake.plans import image_queries, kernel_queries, learn_queries, metric_queries, relational_queries, source_queries  # noqa: F401
from lumenlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
