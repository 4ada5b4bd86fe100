"""Registered queries: streams over the given tables, compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from aetherlog import dims
from aetherlog.operators import aviation as A
from aetherlog.operators import metrics as M
from aetherlog.operators import passes as P
from aetherlog.operators import signal as S
from aetherlog.operators import tablefunctions
from aetherlog.operators import transcripts as T
from aetherlog.operators import control as C
from aetherlog.plans import aviation_queries as AQ
from aetherlog.plans import derived
from aetherlog.plans import signal_queries as SQ
from aetherlog.plans import text_queries as TQ
from aetherlog.plans.blocked import numbered, time_block
from aetherlog.plans.registry import query
from aetherlog.plans.store import stored
from aetherlog.session import shared_folder
from aetherlog.sources import readers, sinks, tables
from aetherlog.streaming import aircraft, correlation, feeds, late, segments, stations


def _stream_of(df, purpose: str, files: int = 4, order: str | None = None, spread: bool = True):
    """Write a derived table in several slices, in the order of a column if there is one, and read one per micro-batch.

    Without ``spread`` rows stay in the files of the tasks that made them, each slice a part of these, and are not shuffled.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    if not spread:
        df.write.parquet(path)
        each = -(-len(spark.read.schema(df.schema).parquet(path).inputFiles()) // files)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(each, 1)).parquet(path)
    if order is None:
        df.repartition(files).write.parquet(path)
    else:  # one slice after the other, as stations would close their files
        rows = stored(df.withColumn("_slice", F.col(order).cast("double")), purpose + "-rows")
        edges = rows.approxQuantile("_slice", [i / files for i in range(1, files)], 0.01)
        each = max(2, rows.rdd.getNumPartitions())  # files of a slice, one batch together
        last = None
        for edge in [*edges, None]:
            part = rows if last is None else rows.filter(F.col("_slice") > last)
            part = part if edge is None else part.filter(F.col("_slice") <= edge)
            part.drop("_slice").repartition(each).write.mode("append").parquet(path)
            last = edge
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1 if order is None else each).parquet(path)


def _updates(t):
    """Telemetry lines of several batches, in the order they were sent."""
    return A.parse_sbs(_stream_of(t.sbs_lines(), "sbs", 3, "ts"))


@query("str_1_vad_segments", "frames", sql=SQ._cuts_sql(SQ.SILENCE) + " SELECT * FROM segments")
def _(t):
    """Frames come in several batches; the segments are those of the batch operator."""
    s = segments.stream_vad_segments(_stream_of(t.frames(), "frames", order="frame_idx"), silence=SQ.SILENCE)
    return feeds.drained(s, "vad").select("stream_id", "start_idx", "end_idx")


@query("str_2_fixed_segments", "frames", sql=SQ._FIXED + " SELECT * FROM fixed")
def _(t):
    """Counted in the JVM; a segment is dropped from the state once the streams are far behind it."""
    frames = t.frames().withColumn("started", F.lit("2024-01-01").cast("timestamp"))
    s = segments.stream_fixed_segments(_stream_of(frames, "frames", order="frame_idx"))
    return feeds.drained(s, "fixed", "update").drop("batch_id").withColumn("rms", F.round("rms", 3))


_SESSION_FRAMES = """, by_session AS (SELECT stream_id || '/' || session AS stream_id, row_number() OVER (PARTITION BY stream_id, session ORDER BY ts, seq) - 1 AS frame_idx, rms, sumsq, n
    FROM (SELECT event_type AS stream_id, user_id % 3 AS session, ts, seq, value AS rms, value * value * 1600 AS sumsq, 1600 AS n FROM ev))"""


@query("str_9_session_segments", "ev", sql="/*RECURSIVE*/" + _SESSION_FRAMES + SQ._cuts_sql(SQ.SILENCE).replace("/*RECURSIVE*/", "").replace("FROM frames", "FROM by_session") + " SELECT * FROM segments")
def _(t):
    """The tuning session is part of the key, so no segment crosses a retune."""
    e = t.events().select(F.col("event_type").alias("stream_id"), (F.col("user_id") % 3).alias("session"), "ts", "seq", "value")
    key = ["stream_id", "session"]
    f = numbered(e, key, ["ts", "seq"], time_block("ts"), "frame_idx").select(
        *key, "frame_idx", F.lit(1600).alias("n"), (F.col("value") * F.col("value") * 1600).alias("sumsq"))
    out = feeds.drained(segments.stream_vad_segments(_stream_of(f, "frames", order="frame_idx"), key, SQ.SILENCE), "sessions")
    return out.select(F.concat_ws("/", "stream_id", F.col("session").cast("string")).alias("stream_id"), "start_idx", "end_idx")


_OVER = f"seen_us + {AQ.GAP_US} <= (SELECT max(us) FROM updates) - 10000000"


@query("str_3_sightings", "track", gap_us=AQ.GAP_US, sql=AQ._STATE + f" SELECT hex, {AQ._COLS}, seen FROM state WHERE {_OVER}")
def _(t):
    return feeds.drained(aircraft.stream_sightings(_updates(t), AQ.GAP), "sightings").select("hex", *AQ._FIELDS, "seen")


@query("str_3_live_aircraft", "track", gap_us=AQ.GAP_US, sql=AQ._STATE + f""" SELECT hex, {AQ._COLS}, seen FROM state WHERE NOT ({_OVER})
    QUALIFY row_number() OVER (PARTITION BY hex ORDER BY sighting DESC) = 1""")
def _(t):
    """What the live table holds at the end: the newest change of each aircraft, unless it expired."""
    changes = feeds.drained(aircraft.stream_aircraft(_updates(t), AQ.GAP), "live", "update")
    newest = M.latest(changes, ["hex"], ["batch_id", "expired"])
    return newest.filter(~F.col("expired")).select("hex", *AQ._FIELDS, "seen")


@query("str_4_pass_notices", "passes", "ticks", sql="""SELECT k.station, satellite, aos, max(round((aos_us - tick_us) / 1000000.0::DOUBLE / 60.0::DOUBLE, 1)) AS minutes_until FROM ticks k
    JOIN passes p ON k.station = p.station AND aos_us - tick_us > 0 AND aos_us - tick_us <= 600000000 GROUP BY 1, 2, 3""")
def _(t):
    """Ticks of several batches; each pass keeps the notice of its first tick."""
    ticks = _stream_of(t.ticks().select("station", "tick"), "ticks", order="tick")
    key = ["station", "satellite", "aos"]
    changes = feeds.drained(feeds.stream_pass_notices(t.passes(), ticks, key, ["station"]), "notices", "update")
    return M.latest(changes, key, ["batch_id"]).select(*key, "minutes_until")


@query("str_5_edge_feed", "status", "presets", sql="""SELECT CAST(station AS VARCHAR) AS key, ts, '{"rms":0.0,"freq":"' || coalesce(p.freq, '') || '"}' AS payload FROM (
    SELECT *, lag(running) OVER (PARTITION BY station ORDER BY us, seq) AS was FROM status) s LEFT JOIN presets p ON p.id = s.preset_id WHERE was AND NOT running""")
def _(t):
    """Zero levels when a station stops, over several batches; on a cluster the trigger is ``EVERY['edges']``."""
    path = shared_folder(t.spark, "edges")
    status = _stream_of(t.status().select("station", "ts", "seq", "running", "preset_id"), "status", 3, "ts")
    feeds.start(status, on_batch=feeds.edge_handler(t.presets(), path)).awaitTermination()
    return t.spark.read.parquet(f"{path}/events").select("key", "ts", "payload")


_CLOCK = "2024-04-01 00:00:00"  # a row of this time ends a stream, so that the watermark passes all rows before


def _sliced(df, purpose: str, at, files: int):
    """A stream that gets one slice of a table per micro-batch, by when its rows arrive; a slice is as many files as Spark writes."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, purpose)
    rows = stored(df.withColumn("_at", at.cast("double")), purpose + "-rows")
    edges = rows.approxQuantile("_at", [i / files for i in range(1, files)], 0.01)
    nth = sum(((F.col("_at") > e).cast("int") for e in edges), F.lit(0))
    for n in range(files):
        rows.filter(nth == n).drop("_at").write.mode("append").parquet(f"{path}/slice={n}")
    return path


@query("str_6_callsign_matches", "track", "utterances", gap_us=AQ.GAP_US, sql=AQ._ASOF + f" SELECT transcript_id, ts, hex, {AQ._COLS}, seen, matched_callsign FROM spoken_of")
def _(t):
    """Two streams of several batches. A tenth of the telemetry comes half a day late, after transcripts it belongs to."""
    spark, clock = t.spark, F.lit(_CLOCK).cast("timestamp")
    track = A.aircraft_track(t.updates(), AQ.GAP)
    said = t.utterances()
    delay = F.when(F.col("seq") % 10 == 3, F.expr("INTERVAL 12 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    streams = []
    for df, purpose, at in ((said, "utterances", F.col("ts")), (track, "track", F.col("ts") + delay)):
        path = _sliced(df, purpose, F.unix_micros(at), 4)
        null = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in ("ts", "hex", "transcript_id")]
        spark.range(1).select(*null, *[F.lit("0").cast(df.schema[c].dataType).alias(c) for c in ("hex", "transcript_id") if c in df.columns],
                              clock.alias("ts")).select(*df.columns).write.parquet(f"{path}/slice=4")
        reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 8)
        streams.append(reader.parquet(path))
    out = correlation.stream_callsign_matches(*streams, AQ.GAP, "1 day")
    return feeds.drained(out, "matches")


@query("str_7_weather_feed", "weather", "presets", sql=TQ._HEARD_FIELDS + TQ._HEARD_ALERTS + f""" SELECT event, key, ts, alert_names, said FROM ({TQ._EVENT})
    UNION ALL SELECT 'alert_log', w.stream_id, w.ts, a.name || '@' || a.area, substr(w.text, 1, 200) FROM alerts a JOIN heard w USING (transcript_id)""")
def _(t):
    """Transcripts of several batches through the handler; every payload is opened and compared."""
    spark, path = t.spark, shared_folder(t.spark, "weather")
    heard = _stream_of(t.weather(), "transcripts", 3, "ts")
    feeds.start(heard, on_batch=feeds.weather_handler(t.presets(), path)).awaitTermination()
    events = TQ._opened(spark.read.parquet(f"{path}/events")).select("event", "key", "ts", "alert_names", "said")
    log = spark.read.parquet(f"{path}/alert_log").select(
        F.lit("alert_log").alias("event"), F.col("stream_id").alias("key"), "ts", F.concat("name", F.lit("@"), "area").alias("alert_names"),
        F.col("snippet").alias("said"))
    return events.union(log)


@query("str_8_bounded_batches", "utterances", sql="SELECT stream_id, count(*) AS n, count(DISTINCT transcript_id) AS ids FROM utterances GROUP BY 1")
def _(t):
    """A rate limit cuts the input into batches; nothing is dropped."""
    out = feeds.drained(_stream_of(t.utterances(), "utterances"), "bounded")
    return out.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("transcript_id").alias("ids"))


@query("str_12_out_of_order", "status", sql="SELECT station, seq, ts, preset_id FROM status QUALIFY row_number() OVER (PARTITION BY station ORDER BY us DESC, seq DESC) = 1")
def _(t):
    """Rows arrive in any order; the newest by event time wins all the same."""
    s = _stream_of(t.status(), "status")
    newest = s.groupBy("station").agg(F.max_by(F.struct("seq", "ts", "preset_id"), F.struct("ts", "seq")).alias("r"))
    last = M.latest(feeds.drained(newest, "newest", "update"), ["station"], ["batch_id"])
    return last.select("station", "r.seq", "r.ts", "r.preset_id")


_LATE_S = 2 * 86400
_SLICE = "least((date_diff('day', TIMESTAMP '2024-01-01', ts)) // 6, 4) + CASE WHEN seq % 5 = 0 THEN 2 ELSE 0 END"


@query("str_12_late_rows", "status", sql=f"""SELECT station, count(*) AS n, count(*) FILTER (behind > {_LATE_S}) AS late_rows, CAST(coalesce(sum(seq) FILTER (behind > {_LATE_S}), 0) AS BIGINT) AS late_sum,
    CAST(coalesce(sum(seq) FILTER (behind <= {_LATE_S} OR behind IS NULL), 0) AS BIGINT) AS main_sum, coalesce(max(behind) FILTER (behind > {_LATE_S}), 0) AS most_behind
    FROM (SELECT station, seq, (max(us) OVER (PARTITION BY station ORDER BY slice RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - us) / 1000000.0::DOUBLE AS behind
    FROM (SELECT station, seq, us, {_SLICE} AS slice FROM status)) GROUP BY 1""")
def _(t):
    """A fifth of the rows comes two slices late. Late rows and the others are two tables, and together the input."""
    spark = t.spark
    path, checkpoint, arrived = (shared_folder(spark, n) for n in ("late", "checkpoint", "arrived"))
    status = stored(t.status().select("station", "seq", "ts"), "status-rows")
    slices = F.least(F.floor(F.datediff("ts", F.lit("2024-01-01")) / 6), F.lit(4)) + F.when(F.col("seq") % 5 == 0, 2).otherwise(0)
    status.limit(0).write.parquet(arrived)  # a folder to watch
    stream = late.mark_late(spark.readStream.schema(status.schema).parquet(arrived), ["station"], _LATE_S)
    for n in range(7):  # a batch takes all that has come
        status.filter(slices == n).write.mode("append").parquet(arrived)
        feeds.start(stream, on_batch=late.split_handler(path), checkpoint=checkpoint).awaitTermination()
    main = spark.read.schema(status.schema).parquet(f"{path}/rows").select(*status.columns, F.lit(0.0).alias("behind_s"), F.lit(False).alias("late"))
    behind = spark.read.schema(stream.schema).parquet(f"{path}/late").select(*main.columns)
    number = F.coalesce(F.sum(F.when(F.col("late"), F.col("seq"))), F.lit(0)).cast("bigint")
    return main.union(behind).groupBy("station").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late_rows"), number.alias("late_sum"),
        F.coalesce(F.sum(F.when(~F.col("late"), F.col("seq"))), F.lit(0)).cast("bigint").alias("main_sum"),
        F.max("behind_s").alias("most_behind"))


def _displays(t):
    heard = _stream_of(t.weather(), "transcripts", 4, "ts")
    shown = feeds.drained(stations.stream_displays(T.heard_reports(heard, t.presets())), "displays", "update")
    last = shown.groupBy("stream_id").agg(F.max("batch_id").alias("batch_id"))
    return shown.join(last, ["stream_id", "batch_id"])


@query("top_5_live_transcripts", "weather", "presets", sql=TQ._HEARD + """ SELECT stream_id, transcript_id, ts, rn, text AS said FROM (SELECT *, CAST(row_number() OVER
    (PARTITION BY stream_id ORDER BY ts DESC, transcript_id DESC) AS INTEGER) AS rn FROM heard WHERE text <> '') WHERE rn <= 3""")
def _(t):
    """What each station's display lists after the last of four batches."""
    return _displays(t).select("stream_id", "transcript_id", "ts", "rn", "said")


@query("str_11_live_banner", "weather", "presets", sql=TQ._HEARD_LOW + TQ._HEARD_ALERTS + TQ._BANNERS.replace(TQ._ALERTS, "") + f""" SELECT b.stream_id, transcript_id,
    CASE WHEN {TQ._PRIORITY} THEN banner END AS banner FROM banner b JOIN heard USING (transcript_id)
    QUALIFY row_number() OVER (PARTITION BY b.stream_id ORDER BY b.ts DESC, transcript_id DESC) = 1""")
def _(t):
    """The banner that each station's display shows after the last of four batches."""
    return _displays(t).filter("rn = 1").select("stream_id", "transcript_id", "banner")


@query("str_10_live_highlights", "track", "utterances", gap_us=AQ.GAP_US, sql=AQ._ASOF + """ SELECT transcript_id, hex, matched_callsign, 'on' AS state, ts AS at FROM spoken_of
    UNION ALL SELECT transcript_id, hex, matched_callsign, 'off', ts + INTERVAL 8 SECONDS FROM spoken_of""")
def _(t):
    """Matches as a stream, each lit for eight seconds."""
    matches = _stream_of(AQ._asof(t).select("transcript_id", "ts", "hex", "matched_callsign"), "matches", 3, spread=False)
    return feeds.drained(stations.stream_highlights(matches, dims.HIGHLIGHT_S), "highlights")


@query("udf_3_batch_handler", "utterances", sql=AQ._CALLS + " SELECT transcript_id, callsign FROM calls")
def _(t):
    """A handler called with each batch of transcripts."""
    spark, path = t.spark, shared_folder(t.spark, "callsigns")

    def on_batch(batch, batch_id: int) -> None:
        calls = A.spoken_callsigns(A.extract_callsigns(batch), "transcript_id")
        calls.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    feeds.start(_stream_of(t.utterances(), "utterances", 2), on_batch=on_batch).awaitTermination()
    return spark.read.parquet(path).select("transcript_id", "callsign")


@query("udf_4_event_sink", "inference_log", sql="""SELECT 'inference_stats' AS event, CAST(stream_id AS VARCHAR) AS key, max(ts) AS ts,
    '{"chunks_processed":' || count(*) FILTER (NOT skipped) || ',"chunks_skipped_silence":' || count(*) FILTER (skipped) || '}' AS payload
    FROM inference_log GROUP BY stream_id""")
def _(t):
    """Typed events through the sink and back."""
    log, path = t.inference_log(), shared_folder(t.spark, "events")
    newest = log.groupBy("stream_id").agg(F.max("ts").alias("ts"))
    stats = M.inference_totals(log).join(newest, "stream_id")
    sinks.write_events(sinks.as_events(
        stats, "inference_stats", "stream_id", "ts", ["chunks_processed", "chunks_skipped_silence"]), path)
    return t.spark.read.parquet(path).select("event", "key", "ts", "payload")


@query("str_1_chunks_to_segments", sql=SQ._FRAMES + """ SELECT stream_id, seg * 10 AS start_idx, seg * 10 + 9 AS end_idx
    FROM (SELECT stream_id, unnest(range(0, count(*) // 10)) AS seg FROM pcm_frames GROUP BY 1)""")
def _(t):
    """A stream of chunks to segments; at this threshold every frame is silent, so each tenth one cuts."""
    chunks = _stream_of(readers.pcm_chunks(t.recordings()), "chunks", 3, "seq")
    return feeds.drained(segments.stream_vad_segments(S.frame_parts(chunks), silence=1e9), "chunk-segments").select(
        "stream_id", "start_idx", "end_idx")


_PCM_SILENCE = 25000.0  # these samples are text bytes: about half of the frames are below


@query("udtf_1_chunks_to_segments", sql=SQ._FRAMES.replace(SQ._CHUNKS, SQ._FILES).replace("WITH ", "WITH RECURSIVE ", 1) + ", frames AS (SELECT stream_id, frame_idx, sqrt(sumsq / n) AS rms FROM pcm_frames)"
       + SQ._cuts_sql(_PCM_SILENCE).replace("/*RECURSIVE*/", "") + " SELECT CAST(stream_id AS VARCHAR) AS stream_id, start_idx, end_idx FROM segments")
def _(t):
    """The table function over chunks, per stream and block, and the blocks' cuts followed."""
    return tablefunctions.segments_of_chunks(readers.pcm_chunks(SQ._recordings(t)), _PCM_SILENCE, block_frames=200)


# --- sinks -------------------------------------------------------------------------------------------

@query("snk_3_upserted_status", "status", sql="SELECT station, seq, ts, running, preset_id FROM status QUALIFY row_number() OVER (PARTITION BY station ORDER BY us DESC, seq DESC) = 1")
def _(t):
    """The current-state table of a stream of five batches, one of which is tried twice; its rows arrive in any order."""
    spark, path = t.spark, shared_folder(t.spark, "status-table")
    status = t.status().select("station", "seq", "ts", "running", "preset_id")
    arrives = _sliced(status, "status", F.pmod(F.xxhash64("seq"), F.lit(1000)), 5)
    handler = tables.upsert_handler(path, ["station"], ["ts", "seq"], buckets=8)

    def twice(batch, batch_id: int) -> None:
        handler(batch, batch_id)
        if batch_id == 2:
            handler(batch, batch_id)

    stream = spark.readStream.schema(status.schema).option("maxFilesPerTrigger", 4).parquet(arrives).select(*status.columns)
    feeds.start(stream, on_batch=twice).awaitTermination()
    return tables.current(spark, path, status.schema)


def _all_events(t):
    """Events of all twelve names."""
    presets, status, log = t.presets(), C.effective_tuning(t.status()), t.inference_log()
    backend = F.when(F.col("seq") % 2 == 0, "cpu").otherwise("hailo")
    newest = log.groupBy("stream_id").agg(F.max("ts").alias("ts"))
    heard = A.transcripts_with_events(AQ._spoken(t), A.aircraft_track(t.updates(), AQ.GAP), AQ.GAP)
    levels = t.events().select(F.col("event_type").alias("stream_id"), "ts", F.col("value").alias("rms"), F.lit(None).cast("string").alias("freq"))
    flights = A.live_aircraft(t.updates(), AQ._at(AQ.NOW), AQ.GAP)
    images = P.images_with_pass(P.parse_image_name(t.images()), t.passes(), ["station", "satellite"], "here")
    parts = [  # planned in the session of the first, whose matches stay where they are found
        sinks.callsign_match_events(heard), sinks.transcript_events(t.weather().withColumn("rms", F.lit(1.5)), presets), sinks.signal_level_events(levels),
        sinks.inference_events(M.inference_totals(log).join(newest, "stream_id")), sinks.weather_events(T.heard_reports(t.weather(), presets)),
        sinks.aircraft_events(flights),
        sinks.pass_events(P.with_frequency(P.notices(t.passes(), t.ticks(), station=["station"]))), sinks.image_events(images),
        sinks.status_events(status, presets), sinks.mode_events(status.withColumn("transcriber_backend", backend)),
        sinks.connection_error_events(M.connection_edges(t.status())), sinks.crash_error_events(M.crash_sequences(t.health()))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_EDGES = "SELECT ts, sdr_connected, lag(sdr_connected, 1, true) OVER (PARTITION BY station ORDER BY us, seq) AS was FROM status"
_COUNTS = f""", counted AS (
    SELECT event, ts FROM ({TQ._EVENT})
    UNION ALL SELECT 'transcript', ts FROM weather
    UNION ALL SELECT 'signal_level', ts FROM ev
    UNION ALL SELECT 'inference_stats', max(ts) FROM inference_log GROUP BY stream_id
    UNION ALL SELECT 'callsign_match', ts FROM (SELECT DISTINCT transcript_id, ts FROM spoken_of)
    UNION ALL SELECT 'adsb_update', seen FROM live
    UNION ALL SELECT 'satellite_pass_upcoming', to_timestamp(min(tick_us) / 1000000) AT TIME ZONE 'UTC' FROM passes p JOIN ticks k ON k.station = p.station
        AND aos_us - tick_us > 0 AND aos_us - tick_us <= 600000000 GROUP BY p.station, p.satellite, p.aos
    UNION ALL SELECT 'apt_image_ready', pass_ts FROM images
    UNION ALL SELECT 'status', ts FROM status
    UNION ALL SELECT 'mode', ts FROM status
    UNION ALL SELECT 'error', ts FROM health WHERE kind = 'crash'
    UNION ALL SELECT 'error', ts FROM ({_EDGES}) WHERE was <> sdr_connected)
    SELECT event, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM counted GROUP BY 1"""


@query("snk_1_all_events", "weather", "presets", "ev", "inference_log", "track", "utterances", "passes", "ticks", "images", "status", "health",
       gap_us=AQ.GAP_US, sql=TQ._HEARD_FIELDS + TQ._HEARD_ALERTS + AQ._ASOF + AQ._live("live", AQ.NOW) + _COUNTS)
def _(t):
    """All twelve events through the committed sink, over several batches, and read back."""
    spark, path = t.spark, shared_folder(t.spark, "all-events")
    events = _stream_of(_all_events(t), "events", 3, spread=False)
    sinks.stream_events(events, path, shared_folder(spark, "checkpoint")).awaitTermination()
    return sinks.read_events(spark, path).groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
