"""op9: every document with its near-duplicate class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentinelle.llm import bagmin
from sentinelle.session import table


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagmin.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


QUERIES = {"op9_near_duplicates": op9_near_duplicates}
ORACLE: dict[str, str] = {}
