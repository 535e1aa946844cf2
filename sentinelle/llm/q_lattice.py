"""op5: every document scored by the lattice model, which learns from six sevenths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinelle.llm import lattice
from sentinelle.llm.q_bpe import tokenizer_path
from sentinelle.session import table

VOCABULARY = "piece_bpe_32k.model"


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op5_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    return lattice.score(docs, tokenizer_path(VOCABULARY), "held_out")


QUERIES = {"op5_lattice_score": op5_lattice_score}
ORACLE: dict[str, str] = {}
