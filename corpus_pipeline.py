"""A training corpus from ``documents``: quality rules, line dedup, near-dedup, decontamination, encoding.

Defined results: documents without text, or with too few words, are rejected by the quality rules; null ids and nulls in
other columns pass through; of rows that agree in id and text one stays, from near-dedup on; a copy under another id loses
its lines to the earlier id, and a document left without a word goes; texts of any length are taken whole; columns
beside those of ``documents``, whatever their names, are left behind; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import common, decontaminate, lines, near, pieces, quality

#: The columns of documents, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy. The ledger rides along with each row, so nothing is shuffled or joined."""
    whole = docs.withColumn("_row", F.struct(*COLUMNS))
    return quality.apply_policy(quality.ledger(whole, id_col="_row")).where("kept").select("doc_id.*").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line matches; n_chars follows the text, and empty texts go."""
    out = lines.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.where(F.col("text").rlike(f"[^{common.ASCII_SPACE}]")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return near.keep_first(docs, shingle=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, checked by decoding."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Near-dedup, decontamination by edit budget and encoding have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
