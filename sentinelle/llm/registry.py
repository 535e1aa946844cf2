"""The numbered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentinelle.llm import q_bagmin, q_bpe, q_cascade, q_chat, q_decontam, q_html, q_lattice, q_licences, q_lines, q_lexical, q_quality, q_suffixes, q_whitening

MODULES = (q_chat, q_decontam, q_lines, q_quality, q_lattice, q_cascade, q_suffixes, q_licences, q_bagmin, q_bpe, q_lexical, q_whitening, q_html)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
