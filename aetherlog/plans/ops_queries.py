"""Registered queries: metrics, edges, presets, tuning, serving tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aetherlog.functions import display as D
from aetherlog.operators import control as C
from aetherlog.operators import metrics as M
from aetherlog.plans.registry import query
from aetherlog.sources import sinks


# --- inference metrics ---------------------------------------------------------------------------

@query("agg_3_inference_totals", "inference_log", sql="""SELECT stream_id, count(*) FILTER (NOT skipped) AS chunks_processed, count(*) FILTER (skipped) AS chunks_skipped_silence,
    CAST(coalesce(sum(tokens) FILTER (NOT skipped), 0) AS BIGINT) AS total_tokens FROM inference_log GROUP BY 1""")
def _(t):
    return M.inference_totals(t.inference_log())


@query("agg_4_silence_pct", "inference_log", sql="SELECT stream_id, CAST(round(100.0::DOUBLE * count(*) FILTER (skipped) / count(*)) AS BIGINT) AS silence_pct FROM inference_log GROUP BY 1")
def _(t):
    return M.silence_pct(t.inference_log())


@query("win_8_running_totals", "inference_log", sql="""SELECT stream_id, seq, count(*) FILTER (NOT skipped) OVER w AS chunks_processed, count(*) FILTER (skipped) OVER w AS chunks_skipped_silence,
    CAST(coalesce(sum(tokens) FILTER (NOT skipped) OVER w, 0) AS BIGINT) AS total_tokens FROM inference_log
    WINDOW w AS (PARTITION BY stream_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(t):
    return M.running_totals(t.inference_log()).select("stream_id", "seq", "chunks_processed", "chunks_skipped_silence", "total_tokens")


_RTF = "CASE WHEN audio_s > 0 THEN round((encoder_ms + decoder_ms) / 1000 / audio_s, 3) ELSE 0 END"


@query("win_12_inference_metrics", "inference_log", sql=f"""SELECT seq, round(encoder_ms + decoder_ms, 1) AS total_ms,
    CASE WHEN decoder_ms > 0 THEN round(tokens / (decoder_ms / 1000), 1) ELSE 0 END AS tokens_per_sec, {_RTF} AS rtf, tokens || '/32' AS decoder_steps
    FROM inference_log WHERE NOT skipped""")
def _(t):
    return M.inference_metrics(t.inference_log()).select("seq", "total_ms", "tokens_per_sec", "rtf", "decoder_steps")


@query("sc_10_rtf_band", "inference_log", sql=f"""SELECT CASE WHEN rtf > 0 THEN CASE WHEN rtf < 0.5 THEN 'good' WHEN rtf < 1 THEN 'warn' ELSE 'bad' END END AS band, count(*) AS n
    FROM (SELECT {_RTF} AS rtf FROM inference_log WHERE NOT skipped) GROUP BY 1""")
def _(t):
    return M.inference_metrics(t.inference_log()).groupBy(D.rtf_band("rtf").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("sc_19_backend_label", "inference_log", sql="SELECT CASE backend WHEN 'hailo' THEN 'Hailo NPU' WHEN 'cpu' THEN 'CPU' ELSE 'None' END AS label, count(*) AS n FROM inference_log GROUP BY 1")
def _(t):
    return t.inference_log().groupBy(D.backend_label("backend").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("sc_23_rounding", "ev", sql="SELECT seq, round(value * 1.41421356::DOUBLE, 1) AS one, round(value * 1.41421356::DOUBLE, 3) AS three FROM ev")
def _(t):
    v = F.col("value") * 1.41421356
    return t.events().select("seq", D.round1(v).alias("one"), D.round3(v).alias("three"))


@query("sc_22_json", "ev", sql="""SELECT seq, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{"seq":' || seq || ',"event_type":"' || event_type || '"}' AS payload FROM ev""")
def _(t):
    return t.events().select(
        "seq", D.from_event_json("props", "k INT")["k"].alias("k"), D.to_event_json("seq", "event_type").alias("payload"))


# --- edges ------------------------------------------------------------------------------------------

@query("win_6_stop_edges", "status", sql="""SELECT station, seq, ts, 0.0::DOUBLE AS rms FROM (SELECT *, lag(running) OVER (PARTITION BY station ORDER BY us, seq) AS was FROM status)
    WHERE was AND NOT running""")
def _(t):
    return M.stop_edges(t.status()).select("station", "seq", "ts", "rms")


@query("win_7_connection_edges", "status", sql="""SELECT station, seq, CASE WHEN was THEN 'sdr_disconnected' ELSE 'sdr_reconnected' END AS event
    FROM (SELECT *, coalesce(lag(sdr_connected) OVER (PARTITION BY station ORDER BY us, seq), true) AS was FROM status) WHERE was <> sdr_connected""")
def _(t):
    return M.connection_edges(t.status()).select("station", "seq", "event")


@query("win_10_crash_sequences", "health", sql="""SELECT station, seq, crash_no, CASE WHEN crash_no <= 3 THEN 'retry' ELSE 'exhausted' END AS action FROM (
    SELECT *, count(*) FILTER (kind = 'crash') OVER (PARTITION BY station, resets ORDER BY us, seq) AS crash_no FROM (
    SELECT *, count(*) FILTER (kind = 'reconnect') OVER (PARTITION BY station ORDER BY us, seq) AS resets FROM health)) WHERE kind = 'crash'""")
def _(t):
    return M.crash_sequences(t.health()).select("station", "seq", "crash_no", "action")


@query("snk_3_latest_status", "status", sql="SELECT station, seq, ts, running, preset_id FROM status QUALIFY row_number() OVER (PARTITION BY station ORDER BY us DESC, seq DESC) = 1")
def _(t):
    return M.latest(t.status(), ["station"], ["ts", "seq"]).select("station", "seq", "ts", "running", "preset_id")


@query("snk_1_mode_events", "status", sql="""SELECT CAST(station AS VARCHAR) AS key, ts, mode, sdr_connected AS sdr_available, CASE WHEN seq % 3 = 0 THEN 'none' ELSE 'cpu' END AS transcriber_backend, adsb_enabled FROM status""")
def _(t):
    status = t.status().withColumn("transcriber_backend", F.when(F.col("seq") % 3 != 0, "cpu"))
    fields = "mode string, sdr_available boolean, transcriber_backend string, adsb_enabled boolean"
    return sinks.mode_events(status).select("key", "ts", F.from_json("payload", fields).alias("p")).select("key", "ts", "p.*")


@query("snk_1_error_events", "status", "health", sql="""SELECT CAST(station AS VARCHAR) AS key, ts, CASE WHEN now THEN 'SDR dongle reconnected.' ELSE 'SDR dongle disconnected. Plug it back in to auto-recover.' END AS message,
    CASE WHEN now THEN NULL ELSE true END AS recoverable, CASE WHEN now THEN 'sdr_reconnected' ELSE 'sdr_disconnect' END AS type
    FROM (SELECT station, ts, sdr_connected AS now, lag(sdr_connected, 1, true) OVER (PARTITION BY station ORDER BY us, seq) AS was FROM status) WHERE now <> was
    UNION ALL SELECT CAST(station AS VARCHAR), ts, CASE WHEN n <= 3 THEN 'Audio source crashed — auto-restarting (attempt ' || n || '/3)...' ELSE 'Audio source crashed after 3 retries. Use Retry to restart.' END, true, 'process_crash'
    FROM (SELECT station, ts, kind, sum(CASE WHEN kind = 'crash' THEN 1 ELSE 0 END) OVER (PARTITION BY station, part ORDER BY us, seq) AS n
        FROM (SELECT *, sum(CASE WHEN kind = 'reconnect' THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY us, seq) AS part FROM health)) WHERE kind = 'crash'""")
def _(t):
    errors = sinks.connection_error_events(M.connection_edges(t.status())).union(sinks.crash_error_events(M.crash_sequences(t.health())))
    fields = "message string, recoverable boolean, type string"
    return errors.select("key", "ts", F.from_json("payload", fields).alias("p")).select("key", "ts", "p.*")


# --- presets -------------------------------------------------------------------------------------------

@query("jn_1_with_preset", "status", "presets", sql="""SELECT seq, preset_id, freq, label, category, CASE WHEN id IS NULL THEN 'Unknown preset' END AS error
    FROM status LEFT JOIN presets p ON p.id = preset_id""")
def _(t):
    s = t.status().select("seq", "preset_id")
    return C.with_preset(s, t.presets()).select("seq", "preset_id", "freq", "label", "category", "error")


@query("src_4_dimensions", "status", "presets", "categories", sql="""SELECT c.category, c.category_label, c.ord, count(*) AS requests FROM status
    JOIN presets p ON p.id = preset_id JOIN categories c ON c.category = p.category GROUP BY 1, 2, 3""")
def _(t):
    s = C.with_preset(t.status().select("seq", "preset_id"), t.presets())
    return s.join(t.categories(), "category").groupBy("category", "category_label", "ord").agg(F.count(F.lit(1)).alias("requests"))


@query("flt_7_available_presets", "status", "presets", sql="SELECT preset_id, count(*) AS requests FROM status JOIN presets p ON p.id = preset_id WHERE stream_url IS NOT NULL GROUP BY 1")
def _(t):
    usable = C.available_presets(t.presets(), "WEBSTREAM").select(F.col("id").alias("preset_id"))
    return t.status().join(usable, "preset_id", "left_semi").groupBy("preset_id").agg(F.count(F.lit(1)).alias("requests"))


@query("flt_8_presets_in_category", "status", "presets", sql="SELECT preset_id, label, count(*) AS requests FROM status JOIN presets p ON p.id = preset_id WHERE category = 'aviation' GROUP BY 1, 2")
def _(t):
    p = C.presets_in(t.presets(), "aviation").select(F.col("id").alias("preset_id"), "label")
    return t.status().join(p, "preset_id").groupBy("preset_id", "label").agg(F.count(F.lit(1)).alias("requests"))


@query("agg_5_presets_by_category", "status", "presets", "categories", sql="""SELECT c.category, c.ord, c.category_label, count(p.id) AS n, coalesce(string_agg(p.id, ',' ORDER BY p.id), '') AS presets
    FROM categories c LEFT JOIN (SELECT * FROM presets WHERE squelch > 0 AND id IN (SELECT preset_id FROM status)) p ON p.category = c.category GROUP BY 1, 2, 3""")
def _(t):
    used = t.presets().filter("squelch > 0").join(t.status().select(F.col("preset_id").alias("id")), "id", "left_semi")
    g = C.presets_by_category(used, t.categories())
    return g.select("category", "ord", "category_label", F.size("presets").alias("n"), F.array_join("presets.id", ",").alias("presets"))


@query("prj_3_effective_sample_rate", "status", sql="SELECT seq, coalesce(nullif(sample_rate, ''), '200k') AS effective_sample_rate FROM status")
def _(t):
    return C.effective_tuning(t.status()).select("seq", "effective_sample_rate")


@query("prj_4_effective_deemp", "status", sql="SELECT seq, coalesce(deemp, mode IN ('fm', 'wbfm')) AS effective_deemp FROM status")
def _(t):
    return C.effective_tuning(t.status()).select("seq", "effective_deemp")


@query("prj_5_squelch", "status", sql="SELECT seq, greatest(0, least(100, squelch)) AS effective_squelch FROM status")
def _(t):
    return C.effective_tuning(t.status()).select("seq", "effective_squelch")


@query("jn_12_view_rules", "status", "presets", sql="""SELECT seq, CASE WHEN NOT map_on THEN 'hidden' WHEN only_map THEN 'full' ELSE 'shown' END AS map_panel, NOT only_map AS transcript_visible,
    weather AS weather_panel, weather AS satellite_panel, map_on AND NOT only_map AS correlation FROM (
    SELECT seq, coalesce(adsb_enabled AND category = 'aviation', false) AS map_on, coalesce(adsb_enabled AND category = 'aviation' AND p.mode = 'adsb', false) AS only_map,
    coalesce(category = 'weather', false) AS weather FROM status LEFT JOIN presets p ON p.id = preset_id)""")
def _(t):
    s = t.status().select("seq", "preset_id", "adsb_enabled")
    return C.view_rules(s, t.presets()).select("seq", "map_panel", "transcript_visible", "weather_panel", "satellite_panel", "correlation")


@query("flt_10_validate_requests", "tune_events", "presets", sql="""SELECT station, seq, CASE WHEN p.id IS NULL THEN 'unknown_preset' WHEN p.stream_url IS NULL THEN 'no_web_stream'
    WHEN EXISTS (SELECT 1 FROM tune_events l WHERE l.kind = 'apt_enter' AND l.station = t.station AND t.us >= l.us AND t.us < l.us + 7200000000) THEN 'locked' ELSE 'ok' END AS reason
    FROM tune_events t LEFT JOIN presets p ON p.id = t.preset_id WHERE t.kind = 'tune'""")
def _(t):
    e = t.tune_events()
    req = e.filter("kind = 'tune'").select("station", "ts", "seq", "preset_id")
    locks = e.filter("kind = 'apt_enter'").select(
        "station", F.col("ts").alias("lock_start"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("lock_end"))
    return C.validate_requests(req, t.presets(), locks, "WEBSTREAM").select("station", "seq", "reason")


# --- tuning history ----------------------------------------------------------------------------------------

@query("win_13_tuning_sessions", "tune_events", sql=""", known AS (SELECT * FROM tune_events WHERE kind <> 'note'),
    modes AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('apt_enter', 'apt_exit') THEN kind = 'apt_enter' END IGNORE NULLS) OVER w, false) AS apt FROM known
        WINDOW w AS (PARTITION BY station ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    state AS (SELECT *, coalesce(lag(apt) OVER (PARTITION BY station ORDER BY us, seq), false) AS was,
        last_value(CASE WHEN kind = 'tune' AND NOT apt THEN preset_id WHEN kind = 'stop' AND NOT apt THEN '' END IGNORE NULLS) OVER w AS base FROM modes
        WINDOW w AS (PARTITION BY station ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    changes AS (SELECT *, lead(ts) OVER (PARTITION BY station ORDER BY us, seq) AS end_ts FROM state
        WHERE CASE WHEN kind IN ('apt_enter', 'apt_exit') THEN apt <> was ELSE NOT apt END)
    SELECT station, ts AS start_ts, end_ts, CASE WHEN NOT apt THEN nullif(base, '') END AS preset_id, apt AS satellite_mode FROM changes
    WHERE apt OR nullif(base, '') IS NOT NULL""")
def _(t):
    return C.tuning_sessions(t.tune_events())


@query("jn_5_preset_as_of", "tune_events", sql="""SELECT s.station, s.seq, t.preset_id FROM (SELECT * FROM tune_events WHERE kind = 'note') s
    ASOF LEFT JOIN (SELECT * FROM tune_events WHERE kind IN ('tune', 'stop')) t ON t.station = s.station AND s.us >= t.us""")
def _(t):
    e = t.tune_events()
    segments = e.filter("kind = 'note'").select("station", "ts", "seq")
    return C.preset_as_of(segments, e.filter("kind IN ('tune', 'stop')")).select("station", "seq", "preset_id")
