"""op12: every embedding on the components of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentinelle.llm import whitening
from sentinelle.session import table


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLE: dict[str, str] = {}
