"""Throughput, health and edge metrics over logs of many stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aetherlog import dims
from aetherlog.plans.blocked import running, time_block


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def inference_totals(log: DataFrame, key: list[str] = ["stream_id"]) -> DataFrame:
    """Segments processed, segments skipped for silence, tokens."""
    skipped = _flag("skipped")
    return log.groupBy(*key).agg(
        F.count_if(~skipped).alias("chunks_processed"),
        F.count_if(skipped).alias("chunks_skipped_silence"),
        F.coalesce(F.sum(F.when(~skipped, F.col("tokens"))), F.lit(0)).cast("bigint").alias("total_tokens"))


def silence_pct(log: DataFrame, key: list[str] = ["stream_id"]) -> DataFrame:
    """Share of skipped segments in whole percent, 0 for an empty log."""
    pct = F.coalesce(F.round(F.try_divide(F.count_if(_flag("skipped")) * 100.0, F.count(F.lit(1)))), F.lit(0.0))
    return log.groupBy(*key).agg(pct.cast("bigint").alias("silence_pct"))


def running_totals(log: DataFrame, key: list[str] = ["stream_id"], order: list[str] = ["ts", "seq"], block_s: int = 3600) -> DataFrame:
    """The counters as they stood after every segment."""
    skipped = _flag("skipped")
    tokens = F.when(~skipped, F.col("tokens").cast("bigint")).otherwise(0)
    return running(
        log, key, order, time_block("ts", block_s),
        chunks_processed=("sum", (~skipped).cast("bigint")),
        chunks_skipped_silence=("sum", skipped.cast("bigint")),
        total_tokens=("sum", tokens))


def inference_metrics(log: DataFrame) -> DataFrame:
    """Latency, tokens per second and real-time factor of each processed segment."""
    enc, dec = F.coalesce("encoder_ms", F.lit(0.0)), F.coalesce("decoder_ms", F.lit(0.0))
    total = enc + dec
    tps = F.when(dec > 0, F.round(F.col("tokens") / (dec / 1000), 1)).otherwise(0.0)
    rtf = F.when(F.col("audio_s") > 0, F.round(total / 1000 / F.col("audio_s"), 3)).otherwise(0.0)
    return log.filter(~_flag("skipped")).withColumns({
        "total_ms": F.round(total, 1), "tokens_per_sec": tps, "rtf": rtf,
        "decoder_steps": F.concat(F.col("tokens").cast("string"), F.lit(f"/{dims.DECODER_STEPS}")),
    })


def stop_edges(status: DataFrame, key: list[str] = ["station"], order: list[str] = ["ts", "seq"], block_s: int = 3600) -> DataFrame:
    """A zero level on each change from running to stopped, and only then."""
    prev = running(status, key, order, time_block("ts", block_s), _was=("lag", F.col("running")))
    return prev.filter(_flag("_was") & ~_flag("running")).drop("_was").withColumn("rms", F.lit(0.0))


def connection_edges(status: DataFrame, key: list[str] = ["station"], order: list[str] = ["ts", "seq"], block_s: int = 3600) -> DataFrame:
    """Device disconnects and reconnects. A station counts as connected at first."""
    prev = running(status, key, order, time_block("ts", block_s), _was=("lag", F.col("sdr_connected")))
    was, now = F.coalesce("_was", F.lit(True)), _flag("sdr_connected")
    edge = F.when(was & ~now, "sdr_disconnected").when(~was & now, "sdr_reconnected")
    return prev.withColumn("event", edge).filter(F.col("event").isNotNull()).drop("_was")


def crash_sequences(
    health: DataFrame, key: list[str] = ["station"], order: list[str] = ["ts", "seq"],
    max_retries: int = dims.MAX_AUTO_RETRIES, block_s: int = 3600,
) -> DataFrame:
    """Number of each crash since the last reconnect, and whether it is retried."""
    crash = (F.col("kind") == "crash").cast("bigint")
    counted = running(health, key, order, time_block("ts", block_s),
                      crash_no=("since", crash, F.col("kind") == "reconnect"))
    retry = F.when(F.col("crash_no") <= max_retries, "retry").otherwise("exhausted")
    return counted.filter(F.col("kind") == "crash").withColumn("action", retry)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest row per key, by partial aggregation instead of a window."""
    rest = [c for c in df.columns if c not in key]
    newest = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return newest.select(*key, "r.*")
