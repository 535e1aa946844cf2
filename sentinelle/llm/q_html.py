"""op13: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentinelle.llm import html
from sentinelle.session import table


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op13_html_text": op13_html_text}
ORACLE: dict[str, str] = {}
