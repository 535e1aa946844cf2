"""op7: every document without the byte strings that repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentinelle.llm import suffixes
from sentinelle.session import table


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents"))


QUERIES = {"op7_repeated_strings": op7_repeated_strings}
ORACLE: dict[str, str] = {}
