"""The registered queries: each maps the given tables to one operator and its result back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aetherlog.llm import alignment, decontamination, extraction, jaccard, line_dedup, pieces, repeats, resampling, sharding, toxicity, warc
from aetherlog.llm import quality_classifier as classifier
from aetherlog.llm import quality_rules as rules


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as transcripts: the source stands for the stream that was heard."""
    return _documents(spark, folder).select(
        F.col("doc_id").alias("transcript_id"), "text", F.col("lang").alias("language"), F.col("source").alias("stream_id"))


def _benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items as references kept for evaluation."""
    return spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("reference_id"), "text")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives and read back."""
    captures = _pages(spark, folder).select(F.col("page_id").alias("capture_id"), F.col("url").alias("stream_url"), F.col("html").alias("payload"))
    records = warc.read_archives(warc.write_archives(captures), payload=False)
    kind = dict(captures.dtypes)["capture_id"]
    return records.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast(kind).alias("refers_to"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row per benchmark item found in a document."""
    out = decontamination.leaked_references(_transcripts(spark, folder), _benchmark(spark, folder))
    return out.select(F.col("transcript_id").alias("doc_id"), F.col("reference_id").alias("item_id"), "start", "stop", "edits")


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract_pages(_pages(spark, folder))


def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_transcripts(_transcripts(spark, folder)).withColumnRenamed("transcript_id", "doc_id")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(_transcripts(spark, folder))
    return out.select(F.col("transcript_id").alias("doc_id"), "n_lines", "n_removed", "n_runs", F.md5("text").alias("text_md5"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.minimax_shards(_transcripts(spark, folder)).withColumnRenamed("transcript_id", "doc_id")


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _transcripts(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("transcript_id"), "quality")
    out = classifier.score_transcripts(docs, classifier.train(docs, labels))
    return out.withColumnRenamed("transcript_id", "doc_id")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = rules.quality_rules(_transcripts(spark, folder))
    return out.select(F.col("transcript_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept")


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    out = pieces.encode(_transcripts(spark, folder), keep=("transcript_id",))
    return out.withColumnRenamed("transcript_id", "doc_id")


def op10_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    out = repeats.remove_repeats(_transcripts(spark, folder))
    return out.select(F.col("transcript_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    out = resampling.resample(_transcripts(spark, folder), _benchmark(spark, folder))
    return out.select(F.col("transcript_id").cast("bigint").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _transcripts(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("transcript_id"), "toxic")
    out = toxicity.score_transcripts(docs, toxicity.train(docs, labels))
    return out.withColumnRenamed("transcript_id", "doc_id")


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.token_links(_transcripts(spark, folder)).withColumnRenamed("transcript_id", "doc_id").withColumn("doc_id", F.col("doc_id").cast("bigint"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontamination, op3_html_extraction, op4_ngram_jaccard, op5_line_dedup, op6_sharding, op7_quality_classifier, op8_quality_rules, op9_sentencepiece, op10_suffix_repeats,
                                   op11_importance_resampling, op12_toxicity, op13_token_alignment)}
ORACLE: dict[str, str] = {"op1_warc": warc.reference_sql(), "op4_ngram_jaccard": jaccard.reference_sql(),
                          "op5_line_dedup": line_dedup.reference_sql(), "op6_sharding": sharding.reference_sql(),
                          "op10_suffix_repeats": repeats.reference_sql(), "op3_html_extraction": extraction.reference_sql(),
                          "op11_importance_resampling": resampling.reference_sql()}
