"""Starting streams, and the feeds built on stateless or per-batch work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from aetherlog import dims
from aetherlog.operators.aviation import aircraft_as_of, extract_callsigns
from aetherlog.operators.metrics import latest, stop_edges
from aetherlog.operators.passes import upcoming
from aetherlog.operators.transcripts import alert_log, heard_reports
from aetherlog.session import STATE_STORE, shared_folder
from aetherlog.sources.sinks import append_alert_log, signal_level_events, weather_events, write_events

# How often each feed is refreshed.
EVERY = {
    "aircraft": "2 seconds", "stats": "5 seconds", "edges": "500 milliseconds",
    "health": "10 seconds", "passes": "30 seconds",
}


def start(
    df: DataFrame, on_batch: Callable[[DataFrame, int], None] | None = None, path: str | None = None,
    every: str | None = None, mode: str = "append", checkpoint: str | None = None,
) -> StreamingQuery:
    """Start a stream into a handler or a Parquet folder.

    Without ``every`` it works off what is there and stops. A handler is called
    again with the same batch id after a failure, so it should overwrite.
    """
    spark = df.sparkSession
    conf = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(conf, "") != STATE_STORE:
        spark.conf.set(conf, STATE_STORE)
    writer = df.writeStream.outputMode(mode).option(
        "checkpointLocation", checkpoint or shared_folder(spark, "checkpoint"))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if on_batch is not None:
        return writer.foreachBatch(on_batch).start()
    return writer.format("parquet").start(path)


def drained(df: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Work off a stream and return all it emitted as a table."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    if mode == "append":
        start(df, path=path).awaitTermination()
    else:
        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

        start(df, on_batch=keep, mode=mode).awaitTermination()
        return spark.read.schema(T.StructType([*df.schema, T.StructField("batch_id", T.LongType())])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stream_pass_notices(
    passes: DataFrame, ticks: DataFrame, key: list[str] = ["satellite", "aos"], station: list[str] = [],
    notice_s: int = dims.NOTICE_S, late_s: int = dims.NOTICE_S,
) -> DataFrame:
    """One notice per pass, that of its first tick, in update mode.

    The notice goes out with the first tick that arrives; should an earlier one arrive later, a corrected
    row follows. A pass is forgotten ``late_s`` after its begin; ticks later than that are dropped.
    """
    due = upcoming(passes, ticks, notice_s, station).withWatermark("aos", f"{late_s} seconds")
    return due.groupBy(*key).agg(F.min_by(F.struct("tick", "minutes_until"), "tick").alias("n")).select(*key, "n.tick", "n.minutes_until")


def weather_handler(presets: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """Handler of transcripts: weather and alert events, and the alert log."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        reports = heard_reports(batch, presets).persist()  # both sinks read the one extraction
        write_events(weather_events(reports), f"{path}/events", batch_id)
        append_alert_log(alert_log(reports), f"{path}/alert_log", batch_id)
        reports.unpersist()

    return on_batch


def callsign_handler(
    track: Callable[[], DataFrame], path: str, max_age_s: int = dims.AIRCRAFT_TTL_S, late_s: int = dims.LATE_TELEMETRY_S,
) -> Callable[[DataFrame, int], None]:
    """Handler of transcripts: spoken callsigns matched with the aircraft states of that time.

    ``track`` opens the state table. A transcript waits until the table has a state ``late_s`` newer than it, so telemetry that
    arrives after the transcript is still matched; what waits goes to the next batch through the folder, and
    ``match_waiting`` matches the rest. Only the time span of a batch is read from the table; its bounds
    and the table's newest moment are all that reaches the driver.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        heard = extract_callsigns(batch).filter(F.size("callsigns") > 0).select("transcript_id", "ts", "callsigns")
        if batch_id:
            heard = heard.unionByName(spark.read.schema(heard.schema).parquet(f"{path}/waiting/batch_id={batch_id - 1}"))
        newest = track().agg(F.max("ts")).first()[0]
        known = F.coalesce(F.col("ts") <= F.lit(newest).cast("timestamp") - F.make_dt_interval(secs=F.lit(late_s)), F.lit(False))
        heard.filter(~known).write.mode("overwrite").parquet(f"{path}/waiting/batch_id={batch_id}")
        _match(heard.filter(known), track(), f"{path}/matches/batch_id={batch_id}", max_age_s)

    return on_batch


def _match(heard: DataFrame, track: DataFrame, path: str, max_age_s: int) -> None:
    first, last = heard.agg(F.min("ts"), F.max("ts")).first()
    first, last = (F.lit(x).cast("timestamp") for x in (first, last))
    since = first - F.make_dt_interval(secs=F.lit(max_age_s))
    recent = track.filter((F.col("ts") >= since) & (F.col("ts") <= last))
    aircraft_as_of(heard, recent, max_age_s).write.mode("overwrite").parquet(path)


def match_waiting(track: DataFrame, path: str, batch_id: int, max_age_s: int = dims.AIRCRAFT_TTL_S) -> None:
    """Match what still waits after a batch, when no more telemetry is to come."""
    heard = track.sparkSession.read.parquet(f"{path}/waiting/batch_id={batch_id}")
    _match(heard, track, f"{path}/matches/batch_id=last", max_age_s)


def edge_handler(
    presets: DataFrame, path: str, key: list[str] = ["station"], order: list[str] = ["ts", "seq"],
) -> Callable[[DataFrame, int], None]:
    """Handler of status rows: a zero ``signal_level`` event when a station stops; use with ``EVERY['edges']`` as trigger.

    The newest row of each station is handed to the next batch through the folder: one row per station, whatever the
    length of the stream. A batch that is tried again overwrites its own folders only.
    """
    tuned = presets.select(F.col("id").alias("preset_id"), "freq")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*key, *order, "running", "preset_id").withColumn("_new", F.lit(True))
        if batch_id:
            before = spark.read.schema(batch.select(*key, *order, "running", "preset_id").schema).parquet(f"{path}/newest/batch_id={batch_id - 1}")
            rows = rows.unionByName(before.withColumn("_new", F.lit(False)))
        latest(rows.drop("_new"), key, order).write.mode("overwrite").parquet(f"{path}/newest/batch_id={batch_id}")
        edges = stop_edges(rows, key, order).filter("_new").join(tuned, "preset_id", "left")
        events = signal_level_events(edges.withColumn("stream_id", F.concat_ws("/", *key)))
        write_events(events, f"{path}/events", batch_id)

    return on_batch
