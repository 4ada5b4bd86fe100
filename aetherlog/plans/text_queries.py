"""Registered queries: transcripts, weather reports, text scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from aetherlog import dims
from aetherlog.functions import display as D
from aetherlog.functions import text as X
from aetherlog.operators import control as C
from aetherlog.operators import metrics as M
from aetherlog.operators import passes as P
from aetherlog.operators import transcripts as T
from aetherlog.plans.registry import query
from aetherlog.session import shared_folder
from aetherlog.sources import readers, sinks

# Python-style strip in RE2
def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{X.SPACE}+', ''), '{X.SPACE}+$', '')"


# --- quality filters ------------------------------------------------------------------------

_UNIT = " OR ".join(
    f"""(length(t) % {k} = 0 AND length(t) // {k} >= 3 AND substr(t, {k}, 1) IN ('-', '–')
    AND strpos(substr(t, 1, {k - 1}), chr(10)) = 0 AND lower(t) = repeat(lower(substr(t, 1, {k})), CAST(length(t) // {k} AS BIGINT)))"""
    for k in range(2, 6))
_REASON = f""", stripped AS (SELECT text_id, text, {_strip('text')} AS t FROM free_text),
reasons AS (SELECT text_id, text, CASE WHEN length(t) <= 1 THEN 'too_short'
    WHEN regexp_matches(t, '^(?i:{dims.NOISE_PHRASES.replace("'", "''")}){X.SPACE}*\\.?{X.SPACE}*$') THEN 'known_phrase'
    WHEN regexp_matches(t, '^[\\[(][^\\n]+[\\])]$') THEN 'bracketed'
    WHEN {_UNIT} THEN 'repetitive'
    WHEN length(t) < 15 AND len(regexp_split_to_array(t, '{X.SPACE}+')) <= 2 THEN 'short_fragment' END AS reason FROM stripped)"""


@query("flt_2_nonempty", "free_text", sql=_REASON + " SELECT text_id FROM stripped WHERE length(t) > 0")
def _(t):
    return T.filter_nonempty(t.free_text()).select("text_id")


@query("flt_3_hallucination_reason", "free_text", sql=_REASON + " SELECT text_id, reason FROM reasons")
def _(t):
    return T.classify_hallucination(t.free_text()).select("text_id", "reason")


@query("flt_3_drop_hallucinations", "free_text", sql=_REASON + " SELECT r.text_id, length(r.text) AS chars FROM reasons r WHERE reason IS NULL")
def _(t):
    return T.drop_hallucinations(t.free_text()).select("text_id", F.length("text").cast("bigint").alias("chars"))


_PRIORITY = " OR ".join(f"contains(lower(text), '{w}')" for w in dims.PRIORITY_WORDS)


@query("flt_12_priority_alerts", "weather", sql=f"SELECT transcript_id FROM weather WHERE {_PRIORITY}")
def _(t):
    return T.priority_alerts(t.weather()).select("transcript_id")


@query("flt_12_priority_free_text", "free_text", sql=f"SELECT text_id, ({_PRIORITY}) AS priority FROM free_text")
def _(t):
    return t.free_text().select("text_id", T.is_priority("text").alias("priority"))


# --- weather extraction ---------------------------------------------------------------------------

def _rx(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(t, '{pattern}', {group}), '')"


_TEMP = "TRY_CAST(coalesce(" + ", ".join(_rx(p) for p in dims.TEMPERATURE_PATTERNS) + ") AS INTEGER)"
_AMOUNT = rf"(\d+)(?:\s+to\s+(\d+))?\s*({dims.SPEED_UNITS})"
_W1 = rf"winds?\s+({dims.DIRECTIONS})\s+(?:at\s+)?{_AMOUNT}"
_W2 = rf"({dims.DIRECTIONS})\s+winds?\s+{_AMOUNT}"
_W3 = r"winds?\s+light\s+and\s+variable"


def _wind(part: str, calm: str) -> str:
    def one(p: str) -> str:
        return {
            "speed": f"CAST(coalesce({_rx(p, 3)}, {_rx(p, 2)}) AS INTEGER)",
            "direction": _rx(p, 1),
            "unit": f"CASE WHEN contains({_rx(p, 4)}, 'knot') THEN 'knots' ELSE 'mph' END",
        }[part]

    return (f"CASE WHEN regexp_matches(t, '{_W1}') THEN {one(_W1)} WHEN regexp_matches(t, '{_W2}') THEN {one(_W2)} "
            f"WHEN regexp_matches(t, '{_W3}') THEN {calm} END")


_VIS = (
    "CASE WHEN " + _rx(r"visibility\s+(\d+)\s*(?:to\s+\d+\s+)?miles?") + " IS NOT NULL THEN CAST("
    + _rx(r"visibility\s+(\d+)\s*(?:to\s+\d+\s+)?miles?") + " AS DOUBLE) "
    r"WHEN regexp_matches(t, 'visibility\s+one\s+quarter\s+miles?') THEN 0.25 "
    r"WHEN regexp_matches(t, 'visibility\s+one\s+half\s+miles?') THEN 0.5 "
    r"ELSE CASE regexp_extract(t, 'visibility\s+(\w+)\s+miles?', 1) "
    + " ".join(f"WHEN '{w}' THEN {n}.0" for w, n in dims.NUMBER_WORDS.items()) + " END END"
)
_AREA = "CASE " + " ".join(f"WHEN contains(t, '{a}') THEN '{a.title()}'" for a in dims.AREAS) + " ELSE '' END"
_FIELDS = f""", fields AS (SELECT *, {_TEMP} AS temperature, {_wind('speed', '0')} AS wind_speed,
    {_wind('direction', "'variable'")} AS wind_direction, {_wind('unit', "'mph'")} AS wind_unit,
    CAST({_VIS} AS DOUBLE) AS visibility, {_AREA} AS area FROM low)"""
_ALERTS = ", alerts AS (" + " UNION ALL ".join(
    f"SELECT stream_id, transcript_id, {i} AS rule, '{k}' AS type, '{p.title()}' || gap || '{k.title()}' AS name, {_AREA} AS area "
    rf"FROM (SELECT *, nullif(regexp_extract(t, '{p}(\s+){k}', 1), '') AS gap FROM low) WHERE gap IS NOT NULL"
    for i, (p, k) in enumerate(dims.ALERT_RULES)) + ")"


def _cuts(words: list[str], extra: int) -> str:
    branches = []
    for i, w in enumerate(words):
        ends = ", ".join(
            f"CASE WHEN strpos(rest, '{o}') > 0 THEN strpos(rest, '{o}') + {len(w)} END" for o in words if o != w)
        branches.append(
            f"SELECT transcript_id, {i} AS pos, '{w.title()}' AS label, trim(substr(hit, 1, CAST(coalesce(least({ends}), length(hit) + 1) - 1 AS BIGINT))) AS forecast, "
            f"{len(w) + extra} AS shortest FROM (SELECT transcript_id, substr(hit, {len(w) + 1}) AS rest, hit FROM "
            f"(SELECT transcript_id, substr(t, CAST(strpos(t, '{w}') AS BIGINT)) AS hit FROM low WHERE contains(t, '{w}')))")
    return "SELECT transcript_id, pos, label, forecast FROM (" + " UNION ALL ".join(branches) + ") WHERE length(forecast) > shortest"


@query("ext_1_temperature", "low", sql=_FIELDS + " SELECT transcript_id, temperature FROM fields")
def _(t):
    return T.extract_temperature(t.weather()).select("transcript_id", F.col("temperature.value").alias("temperature"))


@query("ext_2_wind", "low", sql=_FIELDS + " SELECT transcript_id, wind_speed, wind_direction, wind_unit FROM fields")
def _(t):
    return T.extract_wind(t.weather()).select(
        "transcript_id", F.col("wind.speed").alias("wind_speed"), F.col("wind.direction").alias("wind_direction"), F.col("wind.unit").alias("wind_unit"))


@query("ext_3_visibility", "low", sql=_FIELDS + " SELECT transcript_id, visibility FROM fields")
def _(t):
    return T.extract_visibility(t.weather()).select("transcript_id", F.col("visibility.value").alias("visibility"))


@query("ext_4_alerts", "low", sql=_ALERTS + " SELECT transcript_id, type, name, area FROM alerts")
def _(t):
    return T.alert_rows(T.extract_alerts(t.weather()), "transcript_id").select("transcript_id", "a.*")


@query("ext_5_area", "low", sql=_FIELDS + " SELECT transcript_id, area FROM fields")
def _(t):
    return T.extract_area(t.weather()).select("transcript_id", "area")


@query("ext_6_marine", "low", sql=_cuts(dims.MARINE_ZONES, 5))
def _(t):
    return T.extract_marine(t.weather()).select("transcript_id", F.posexplode("marine").alias("i", "m")).select(
        "transcript_id", _list_pos("m.zone", dims.MARINE_ZONES).alias("pos"), F.col("m.zone").alias("label"), "m.forecast")


@query("ext_7_forecast", "low", sql=_cuts(dims.FORECAST_PERIODS, 3))
def _(t):
    return T.extract_forecast(t.weather()).select("transcript_id", F.explode("forecast").alias("m")).select(
        "transcript_id", _list_pos("m.period", dims.FORECAST_PERIODS).alias("pos"), F.col("m.period").alias("label"), "m.forecast")


def _list_pos(c: str, words: list[str]):
    return F.array_position(F.array(*[F.lit(w.title()) for w in words]), F.col(c)) - 1


_CONF = """CASE (temperature IS NOT NULL)::INT + (wind_speed IS NOT NULL)::INT + (visibility IS NOT NULL)::INT
    WHEN 3 THEN 'full' WHEN 0 THEN 'low' ELSE 'partial' END"""


@query("ext_8_confidence", "low", sql=_FIELDS + f" SELECT {_CONF} AS confidence, count(*) AS n FROM fields GROUP BY 1")
def _(t):
    return T.weather_reports(t.weather()).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


@query("ext_9_weather_reports", "low", sql=_FIELDS + _ALERTS + f""" SELECT f.transcript_id, temperature, wind_speed, visibility, {_CONF} AS confidence,
    text AS raw_transcript, ts AS parsed_at, coalesce(a.names, '') AS alert_names FROM fields f
    LEFT JOIN (SELECT transcript_id, string_agg(name, ';' ORDER BY rule) AS names FROM alerts GROUP BY 1) a USING (transcript_id)""")
def _(t):
    return T.weather_reports(t.weather()).select(
        "transcript_id", F.col("temperature.value").alias("temperature"), F.col("wind.speed").alias("wind_speed"),
        F.col("visibility.value").alias("visibility"), "confidence", "raw_transcript", "parsed_at",
        F.array_join("alerts.name", ";").alias("alert_names"))


@query("ext_11_post_process", "low", "presets", sql=_FIELDS + f""" SELECT w.transcript_id, p.parser,
    CASE WHEN p.parser = 'noaa' THEN {_CONF} END AS confidence FROM fields w LEFT JOIN presets p ON p.id = w.preset_id""")
def _(t):
    out = T.post_process(t.weather(), t.presets(), {"noaa": T.weather_reports})
    return out.select("transcript_id", "parser", "confidence")


@query("udf_2_parser_registry", "low", "presets", sql=_FIELDS + f""" SELECT coalesce(p.parser, 'none') AS parser, count(*) AS n,
    count(CASE WHEN p.parser = 'noaa' THEN temperature END) AS with_temperature FROM fields w LEFT JOIN presets p ON p.id = w.preset_id GROUP BY 1""")
def _(t):
    out = T.post_process(t.weather(), t.presets(), {"noaa": T.extract_temperature})
    return out.groupBy(F.coalesce("parser", F.lit("none")).alias("parser")).agg(
        F.count(F.lit(1)).alias("n"), F.count("temperature.value").alias("with_temperature"))


_BANNER = _ALERTS + """, banner AS (SELECT w.transcript_id, w.stream_id, w.ts, coalesce(b.txt, nullif(substr(text, 1, 200), ''), 'Weather alert detected') AS banner FROM weather w
    LEFT JOIN (SELECT transcript_id, string_agg(name || CASE WHEN area <> '' THEN ' — ' || area ELSE '' END || '. ', '' ORDER BY rule) AS txt
    FROM alerts GROUP BY 1) b USING (transcript_id))"""


@query("ext_14_alert_banner", "low", sql=_BANNER + " SELECT transcript_id, banner FROM banner")
def _(t):
    return T.weather_reports(t.weather()).select("transcript_id", T.alert_banner().alias("banner"))


@query("prj_8_weather_card", "low", sql=_FIELDS + """ SELECT transcript_id, CAST(temperature AS VARCHAR) || '°F' AS temp_text,
    CASE WHEN wind_speed = 0 THEN 'Light & variable' WHEN wind_speed IS NULL THEN '' ELSE wind_direction || ' ' || wind_speed || ' ' || wind_unit END AS wind_text,
    CASE WHEN visibility = floor(visibility) THEN CAST(CAST(visibility AS BIGINT) AS VARCHAR) ELSE CAST(visibility AS VARCHAR) END || ' miles' AS vis_text FROM fields""")
def _(t):
    return T.weather_card(T.weather_reports(t.weather())).select("transcript_id", "temp_text", "wind_text", "vis_text")


# Only presets with the weather parser give reports; their texts are stripped first.
_HEARD = f""", heard AS (SELECT w.* REPLACE ({_strip('w.text')} AS text), p.freq, lower({_strip('w.text')}) AS t0 FROM weather w
    JOIN presets p ON p.id = w.preset_id WHERE p.parser = 'noaa')"""
# the same fields and alerts as above, over the heard transcripts alone
_HEARD_LOW = _HEARD + ", hlow AS (SELECT * EXCLUDE (t0), t0 AS t FROM heard)"
_HEARD_FIELDS = _HEARD_LOW + _FIELDS.replace("FROM low)", "FROM hlow)")
_HEARD_ALERTS = _ALERTS.replace("FROM low)", "FROM hlow)")


@query("snk_2_alert_log", "weather", "presets", sql=_HEARD_LOW + _HEARD_ALERTS + """ SELECT w.stream_id, w.ts, w.freq, a.type, a.name, a.area, w.source,
    substr(w.text, 1, 200) AS snippet FROM alerts a JOIN heard w USING (transcript_id)""")
def _(t):
    return T.alert_log(T.heard_reports(t.weather(), t.presets()))


_EVENT = f"""SELECT 'weather_update' AS event, stream_id AS key, ts, temperature, wind_speed, wind_direction, visibility, {_CONF} AS confidence,
    coalesce(a.names, '') AS alert_names, text AS said, NULL AS freq, NULL AS source FROM fields f
    LEFT JOIN (SELECT transcript_id, string_agg(name || '@' || area, ';' ORDER BY rule) AS names FROM alerts GROUP BY 1) a USING (transcript_id)
    UNION ALL SELECT 'priority_alert', stream_id, ts, NULL, NULL, NULL, NULL, NULL, coalesce(a.names, ''), substr(text, 1, 200), freq, source FROM fields f
    LEFT JOIN (SELECT transcript_id, string_agg(name || '@' || area, ';' ORDER BY rule) AS names FROM alerts GROUP BY 1) a USING (transcript_id)
    WHERE {_PRIORITY}"""
_PAYLOAD = ("temperature struct<value:int>, wind struct<speed:int,direction:string>, visibility struct<value:double>, confidence string, "
            "alerts array<struct<name:string,area:string>>, raw_transcript string, raw_snippet string, freq string, source string, "
            "parsed_at timestamp, timestamp timestamp")


def _opened(events):
    """The payloads' fields, so that they are compared and not only counted."""
    p = events.withColumn("p", F.from_json("payload", _PAYLOAD)).withColumn("at", F.coalesce("p.parsed_at", "p.timestamp"))
    names = F.transform("p.alerts", lambda a: F.concat(a["name"], F.lit("@"), a["area"]))
    return p.select(
        "event", "key", F.col("at").alias("ts"), F.col("p.temperature.value").alias("temperature"), F.col("p.wind.speed").alias("wind_speed"),
        F.col("p.wind.direction").alias("wind_direction"), F.col("p.visibility.value").alias("visibility"), "p.confidence",
        F.array_join(names, ";").alias("alert_names"), F.coalesce("p.raw_transcript", "p.raw_snippet").alias("said"), "p.freq", "p.source")


@query("snk_1_weather_events", "weather", "presets", sql=_HEARD_FIELDS + _HEARD_ALERTS + " " + _EVENT)
def _(t):
    return _opened(sinks.weather_events(T.heard_reports(t.weather(), t.presets())))


@query("snk_1_transcript_events", "weather", "presets", sql=f"""SELECT stream_id AS key, ts, '{{"timestamp":"' || strftime(ts, '%H:%M:%S') || '","freq":"' || coalesce(p.freq, '') || '","label":"' || coalesce(p.label, '')
    || '","text":"' || {_strip('w.text')} || '","rms":' || CAST(transcript_id % 100 AS VARCHAR) || '.5}}' AS payload FROM weather w LEFT JOIN presets p ON p.id = w.preset_id""")
def _(t):
    heard = t.weather().withColumn("rms", F.col("transcript_id") % 100 + 0.5)
    return sinks.transcript_events(heard, t.presets()).select("key", "ts", "payload")


@query("snk_1_signal_events", "ev", sql="""SELECT event_type AS key, ts, '{"rms":' || CAST(seq % 1000 AS VARCHAR) || '.5,"freq":"' || CASE WHEN seq % 2 = 0 THEN '162.550M' ELSE '' END || '"}' AS payload FROM ev""")
def _(t):
    levels = t.events().select(F.col("event_type").alias("stream_id"), "ts", (F.col("seq") % 1000 + 0.5).alias("rms"),
                               F.when(F.col("seq") % 2 == 0, "162.550M").alias("freq"))
    return sinks.signal_level_events(levels).select("key", "ts", "payload")


@query("snk_1_pass_events", "passes", "ticks", sql="""SELECT satellite AS key, to_timestamp(tick_us / 1000000) AT TIME ZONE 'UTC' AS ts, CASE satellite WHEN 'NOAA 15' THEN '137.6200M' WHEN 'NOAA 19' THEN '137.9125M' ELSE '' END AS frequency,
    aos, max_elevation, duration_s AS duration, round((aos_us - tick_us) / 1000000.0::DOUBLE / 60.0::DOUBLE, 1) AS minutes_until FROM (SELECT p.*, min(tick_us) AS tick_us FROM passes p
    JOIN ticks k ON k.station = p.station AND aos_us - tick_us > 0 AND aos_us - tick_us <= 600000000 GROUP BY ALL)""")
def _(t):
    due = P.with_frequency(P.notices(t.passes(), t.ticks(), station=["station"]))
    fields = "satellite string, frequency string, aos timestamp, max_elevation double, duration bigint, minutes_until double"
    return sinks.pass_events(due).select("key", "ts", F.from_json("payload", fields).alias("p")).select(
        "key", "ts", "p.frequency", "p.aos", "p.max_elevation", "p.duration", "p.minutes_until")


@query("snk_1_image_events", "images", "passes", sql="""SELECT satellite AS key, pass_ts AS ts, url, pass_time, max_elevation, 'here' AS location FROM (
    SELECT i.image_id, i.satellite, i.pass_ts, i.url, i.pass_time, coalesce(arg_max(p.max_elevation, p.aos_us), 0.0) AS max_elevation
    FROM images i LEFT JOIN passes p ON p.station = i.station AND p.satellite = i.satellite
    AND epoch_us(i.pass_ts) BETWEEN p.aos_us - 120000000 AND p.los_us GROUP BY ALL)""")
def _(t):
    images = P.images_with_pass(P.parse_image_name(t.images()), t.passes(), ["station", "satellite"], "here")
    fields = "url string, pass_time string, max_elevation double, location string"
    return sinks.image_events(images).select("key", "ts", F.from_json("payload", fields).alias("p")).select("key", "ts", "p.*")


@query("snk_1_status_events", "status", "presets", sql="""SELECT CAST(station AS VARCHAR) AS key, ts, seq, running, coalesce(p.freq, '') AS freq, coalesce(p.label, '') AS label,
    greatest(0, least(100, s.squelch)) AS squelch, sdr_connected, adsb_enabled FROM status s LEFT JOIN presets p ON p.id = s.preset_id""")
def _(t):
    status = C.effective_tuning(t.status()).withColumn("squelch", F.col("effective_squelch")).withColumn("gain", F.col("seq").cast("string"))
    fields = "running boolean, freq string, label string, squelch int, gain string, sdr_connected boolean, adsb_enabled boolean"
    opened = sinks.status_events(status, t.presets()).select("key", "ts", F.from_json("payload", fields).alias("p"))
    return opened.select("key", "ts", F.col("p.gain").cast("bigint").alias("seq"), "p.running", "p.freq", "p.label", "p.squelch",
                         "p.sdr_connected", "p.adsb_enabled")


_BANNERS = _BANNER.replace("FROM weather w", "FROM heard w")


@query("str_11_active_banner", "weather", "presets", sql=_HEARD_LOW + _HEARD_ALERTS + _BANNERS.replace(_ALERTS, "") + f""" SELECT b.stream_id, transcript_id,
    CASE WHEN {_PRIORITY} THEN banner END AS banner FROM banner b JOIN heard USING (transcript_id)
    QUALIFY row_number() OVER (PARTITION BY b.stream_id ORDER BY b.ts DESC, transcript_id DESC) = 1""")
def _(t):
    """The banner of the newest report; it goes away with a report that is no priority alert."""
    newest = M.latest(T.heard_reports(t.weather(), t.presets()), ["stream_id"], ["ts", "transcript_id"])
    return newest.select("stream_id", "transcript_id", T.active_banner().alias("banner"))


@query("agg_10_latest_weather", "weather", "presets", sql=_HEARD_FIELDS + """ SELECT stream_id, transcript_id, temperature, wind_speed, visibility FROM fields
    QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY ts DESC, transcript_id DESC) = 1""")
def _(t):
    r = M.latest(T.heard_reports(t.weather(), t.presets()), ["stream_id"], ["ts", "transcript_id"])
    return r.select("stream_id", "transcript_id", F.col("temperature.value").alias("temperature"),
                    F.col("wind.speed").alias("wind_speed"), F.col("visibility.value").alias("visibility"))


@query("top_5_recent_transcripts", "weather", "presets", sql=_HEARD + """ SELECT stream_id, transcript_id, ts, rn, text AS said FROM (SELECT *, CAST(row_number() OVER
    (PARTITION BY stream_id ORDER BY ts DESC, transcript_id DESC) AS INTEGER) AS rn FROM heard WHERE text <> '') WHERE rn <= 3""")
def _(t):
    reports = T.heard_reports(t.weather(), t.presets())
    return T.recent_transcripts(reports, 3, order=("ts", "transcript_id")).select(
        "stream_id", "transcript_id", "ts", "rn", F.col("raw_transcript").alias("said"))


@query("top_6_first_pattern", "low", sql="SELECT transcript_id, CASE " + " ".join(
    f"WHEN regexp_matches(t, '{p}') THEN {i}" for i, p in enumerate(dims.TEMPERATURE_PATTERNS)) + " END AS pattern FROM low")
def _(t):
    hit = F.coalesce(*[F.when(F.lower("text").rlike(p), i) for i, p in enumerate(dims.TEMPERATURE_PATTERNS)])
    return t.weather().select("transcript_id", hit.alias("pattern"))


@query("top_7_transcript_feed", "weather", "presets", sql="""SELECT transcript_id, strftime(ts, '%H:%M:%S') || ' [' || coalesce(p.label, '') || '] ' || text AS line
    FROM weather w LEFT JOIN presets p ON p.id = w.preset_id""")
def _(t):
    labelled = C.with_preset(t.weather(), t.presets()).withColumn("label", F.coalesce("label", F.lit("")))
    return T.transcript_feed(labelled, ("ts", "transcript_id")).select("transcript_id", "line")


@query("src_2_frame_lines", sql=f"""SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT doc_id, {_strip('line')} AS line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE line <> '' GROUP BY 1""")
def _(t):
    lines = readers.frame_lines(t.read("documents").select("doc_id", F.col("text").alias("value")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"))


@query("src_6_union_sources", "weather", "utterances", sql="""SELECT source, count(*) AS n, min(ts) AS first_ts, count(preset_id) AS with_preset FROM (
    SELECT 'radio' AS source, ts, preset_id FROM weather UNION ALL SELECT 'web', ts, NULL FROM utterances) GROUP BY 1""")
def _(t):
    radio = t.weather().select("transcript_id", "ts", "text", "preset_id")
    both = readers.union_sources(radio=radio, web=t.utterances().select("transcript_id", "ts", "text"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.count("preset_id").alias("with_preset"))


@query("set_1_union", "weather", "utterances", sql="""SELECT transcript_id, 'radio' AS source, preset_id FROM weather
    UNION ALL SELECT transcript_id, 'web', NULL FROM utterances""")
def _(t):
    return readers.union_sources(
        radio=t.weather().select("transcript_id", "preset_id"), web=t.utterances().select("transcript_id"))


@query("src_7_transcripts", "weather", "presets", sql="""SELECT stream_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(p.freq) AS tuned,
    count(DISTINCT transcript_id) AS ids, count(CASE WHEN transcript_id % 2 = 0 THEN 'en' END) AS with_language, CAST(sum(length(text)) AS BIGINT) AS chars FROM weather w LEFT JOIN presets p ON p.id = w.preset_id GROUP BY 1""")
def _(t):
    """Transcripts written to the shared folder and read back by their reader."""
    heard = C.with_preset(t.weather(), t.presets()).select(
        "transcript_id", "stream_id", "ts", "preset_id", "freq", "label", F.when(F.col("transcript_id") % 2 == 0, "en").alias("language"),
        "text", F.lit(100.0).alias("rms"))
    path = shared_folder(t.spark, "transcripts")
    heard.write.parquet(path)
    return readers.transcripts(t.spark, path).groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("freq").alias("tuned"),
        F.count_distinct("transcript_id").alias("ids"), F.count("language").alias("with_language"), F.sum(F.length("text")).alias("chars"))


# --- scalars -------------------------------------------------------------------------------------------

@query("sc_1_strip", "free_text", sql=f"SELECT text_id, md5({_strip('text')}) AS digest FROM free_text")
def _(t):
    return t.free_text().select("text_id", F.md5(X.strip_ws("text").cast("binary")).alias("digest"))


@query("sc_2_title", "low", sql="SELECT transcript_id, " + _AREA + " AS place FROM low")
def _(t):
    low = F.lower("text")
    hit = F.coalesce(*[F.when(low.contains(a), F.lit(a)) for a in dims.AREAS], F.lit(""))
    return t.weather().select("transcript_id", X.title(hit).alias("place"))


@query("sc_3_find", "free_text", sql="SELECT text_id, strpos(text, 'the') AS first_at, CASE WHEN strpos(substr(text, 11), 'the') > 0 THEN strpos(substr(text, 11), 'the') + 10 ELSE 0 END AS later_at FROM free_text")
def _(t):
    return t.free_text().select("text_id", X.find("text", "the").alias("first_at"), X.find("text", "the", 11).alias("later_at"))


@query("sc_4_snippet", "free_text", sql="SELECT text_id, substr(text, 1, 200) AS snippet FROM free_text")
def _(t):
    return t.free_text().select("text_id", X.snippet("text").alias("snippet"))


@query("sc_5_word_count", "free_text", sql=f"""SELECT text_id, CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '{X.SPACE}+')) END AS words
    FROM (SELECT text_id, {_strip('text')} AS t FROM free_text)""")
def _(t):
    return t.free_text().select("text_id", X.word_count("text").alias("words"))


@query("sc_6_regex", "free_text", sql=r"SELECT text_id, nullif(regexp_extract(text, '([a-z]+)ing', 1), '') AS stem, len(regexp_extract_all(text, '([a-z]+)ing', 1)) AS hits FROM free_text")
def _(t):
    return t.free_text().select("text_id", X.rx("text", r"([a-z]+)ing").alias("stem"), F.size(X.rx_all("text", r"([a-z]+)ing")).alias("hits"))


@query("sc_7_word_to_number", "weather", sql="SELECT transcript_id, CASE regexp_extract(text, 'visibility (\\w+) mile', 1) " + " ".join(
    f"WHEN '{w}' THEN {n}" for w, n in dims.NUMBER_WORDS.items()) + " END AS number FROM weather")
def _(t):
    return t.weather().select("transcript_id", X.word_to_number(X.rx("text", r"visibility (\w+) mile"), dims.NUMBER_WORDS).alias("number"))


@query("sc_17_alert_class", "low", sql=_ALERTS + """ SELECT CASE type WHEN 'warning' THEN 'alert-warning' WHEN 'watch' THEN 'alert-watch' ELSE 'alert-advisory' END AS cls, count(*) AS n
    FROM alerts GROUP BY 1""")
def _(t):
    a = T.alert_rows(T.extract_alerts(t.weather()))
    return a.groupBy(D.alert_class("a.type").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("sc_21_array_functions", "low", sql=_ALERTS + """ SELECT transcript_id, count(type) AS alerts, count(DISTINCT type) AS kinds, arg_min(name, rule) AS first_name
    FROM low LEFT JOIN alerts USING (transcript_id) GROUP BY 1""")
def _(t):
    return T.extract_alerts(t.weather()).select(
        "transcript_id", F.size("alerts").alias("alerts"), F.size(F.array_distinct("alerts.type")).alias("kinds"),
        F.try_element_at("alerts.name", F.lit(1)).alias("first_name"))
