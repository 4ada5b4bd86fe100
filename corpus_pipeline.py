"""From raw documents to token ids: the stages of the training-data pipeline.

Each stage takes ``(spark, docs, folder)`` with the columns of ``documents`` and works on all rows its
predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aetherlog.llm import decontamination, jaccard, line_dedup, pieces
from aetherlog.llm import quality_rules as rules
from aetherlog.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the base rules and lie inside their stratum's fences."""
    verdict = rules.quality_rules(docs, "doc_id", "text", "lang", "source")
    stay = verdict.filter("kept").select(F.col("doc_id").alias("__stay"))
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__stay")), "left_semi").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without later copies of passages of whole lines; a document that was nothing but copies goes."""
    out = line_dedup.dedup_lines(docs, "doc_id", keep=("lang", "source"))
    return out.filter((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of documents with similar shingle sets, the one with the smallest id."""
    groups = jaccard.similar_transcripts(docs, "doc_id")
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay"))
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__stay")), "left_semi").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontamination.decontaminate(docs, items, "doc_id", reference_key="item_id").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text."""
    return pieces.encode(docs, keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
