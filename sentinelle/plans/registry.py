"""All queries of the engine and the SQL that checks them, gathered from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentinelle.plans import q_analytics, q_conflicts, q_correlate, q_more, q_sources, q_spatial, q_text

MODULES = (q_analytics, q_spatial, q_conflicts, q_text, q_correlate, q_more, q_sources)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
