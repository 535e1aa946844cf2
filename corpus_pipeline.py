"""From raw documents to token ids: five stages, each one operator over all that the stage before it kept.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of `documents`; the last
returns each remaining document's ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinelle.llm import bagmin, bpe, decontam, lines, quality, storage
from sentinelle.llm.q_bpe import tokenizer_path
from sentinelle.session import table

#: Contaminated documents whose keys may be broadcast (8 bytes each); more meet the documents in a shuffle.
BROADCAST_KEYS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return quality.kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from texts, and with them documents that had nothing else."""
    p = storage.free(docs, "line_")
    n, removed = F.col(f"{p}n"), F.col(f"{p}removed")
    out = lines.without_boilerplate(docs, prefix=p).where((n > removed) | (removed == 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return bagmin.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items contaminate go."""
    key = storage.free(docs, "_key")
    marked = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    index = decontam.build_index(marked, key)
    judged = decontam.judged(index, decontam.search(index, table(spark, sf_dir, "benchmark")))
    bad = storage.written(judged.where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return marked.join(F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad, key, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left, and a digest of what they decode to."""
    coded = bpe.encode(docs, tokenizer_path())
    return coded.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Signatures and subword merges have no SQL; the pipeline is tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
