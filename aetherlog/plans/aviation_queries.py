"""Registered queries: telemetry, aircraft state, callsigns, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from aetherlog import dims
from aetherlog.functions import text as X
from aetherlog.operators import aviation as A
from aetherlog.operators import transcripts as T
from aetherlog.plans.registry import query
from aetherlog.session import shared_folder
from aetherlog.sources import readers

# Updates are sparse here (a few per aircraft and day), so a day takes the place of ten minutes.
GAP = 86400
GAP_US = GAP * 1000000
NOW, BEFORE, SOON = "2024-01-20 00:00:00", "2024-01-15 00:00:00", "2024-01-03 00:00:00"
_FIELDS = ["flight", "altitude", "speed", "track", "lat", "lon", "vert_rate", "squawk"]
_COLS = ", ".join(_FIELDS)


def _at(text: str):
    return F.lit(text).cast("timestamp")


def _us(text: str) -> str:
    return f"epoch_us(TIMESTAMP '{text}')"


_STATE = f""", state AS (SELECT hex, sighting, {_COLS}, ts AS seen, us AS seen_us FROM track
    QUALIFY row_number() OVER (PARTITION BY hex, sighting ORDER BY us DESC, seq DESC) = 1)"""


def _live(name: str, at: str) -> str:
    return f""", {name} AS (SELECT hex, {_COLS}, ts AS seen FROM track WHERE us <= {_us(at)}
    QUALIFY row_number() OVER (PARTITION BY hex ORDER BY us DESC, seq DESC) = 1 AND us >= {_us(at)} - {GAP_US})"""


# Callsigns of the utterances: family and position give the order, the first one of a text counts.
_NAMES = "|".join(dims.AIRLINES)
_CODE = "CASE lower(who) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.AIRLINES.items()) + " ELSE upper(who) END"
_CALLS = rf""", spoken AS (
    SELECT transcript_id, i, {_CODE} || n AS callsign FROM (SELECT transcript_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS who, unnest(b) AS n FROM
        (SELECT transcript_id, regexp_extract_all(text, '(?i)\b({_NAMES})\s+(\d{{1,4}})\b', 1) AS a, regexp_extract_all(text, '(?i)\b({_NAMES})\s+(\d{{1,4}})\b', 2) AS b FROM utterances))
    UNION ALL
    SELECT transcript_id, 1000 + i, who || n FROM (SELECT transcript_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS who, unnest(b) AS n FROM
        (SELECT transcript_id, regexp_extract_all(text, '\b([A-Z]{{3}})\s*(\d{{1,4}})\b', 1) AS a, regexp_extract_all(text, '\b([A-Z]{{3}})\s*(\d{{1,4}})\b', 2) AS b FROM utterances))
    UNION ALL
    SELECT transcript_id, 2000 + i, upper(who) FROM (SELECT transcript_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS who FROM
        (SELECT transcript_id, regexp_extract_all(text, '(?i)\b(N\d{{1,5}}[A-Z]{{0,2}})\b', 1) AS a FROM utterances))),
calls AS (SELECT transcript_id, callsign, row_number() OVER (PARTITION BY transcript_id ORDER BY min(i)) - 1 AS pos FROM spoken GROUP BY 1, 2)"""


def _spoken(t):
    return A.extract_callsigns(t.utterances())


def _calls(t):
    return A.spoken_callsigns(_spoken(t), "transcript_id")


# --- parsing and state ------------------------------------------------------------------------

@query("prj_1_parse_sbs", "updates", sql=f"SELECT seq, ts, hex, {_COLS} FROM updates")
def _(t):
    return t.updates().select("seq", "ts", "hex", *_FIELDS)


@query("src_2_telemetry_files", "updates", sql="""SELECT hex, count(*) AS n, min(make_timestamp(us // 1000 * 1000)) AS first_ts, max(make_timestamp(us // 1000 * 1000)) AS last_ts,
    count(flight) AS named FROM updates GROUP BY 1""")
def _(t):
    """Telemetry lines from text files: each line's own time, as the line says it."""
    path = shared_folder(t.spark, "telemetry")
    t.sbs_lines().select("value").write.text(path)
    return A.parse_sbs(readers.read_sbs(t.spark, path)).groupBy("hex").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("flight").alias("named"))


@query("src_2_line_numbers", "sbs_lines", sql="""SELECT k, s, count(*) AS n, min(line) AS first_line, max(line) AS last_line, CAST(sum(line) AS BIGINT) AS total
    FROM (SELECT seq // 5000 AS k, seq % 7 AS s, row_number() OVER (PARTITION BY seq // 5000 ORDER BY seq) - 1 AS line FROM sbs_lines) GROUP BY 1, 2""")
def _(t):
    """Telemetry files in the order of their messages, each read in many splits: every line gets its own number."""
    spark, path = t.spark, shared_folder(t.spark, "telemetry")
    lines = t.sbs_lines().select(F.concat_ws("#", "value", F.col("seq").cast("string")).alias("value"), F.floor(F.col("seq") / 5000).alias("k"), "seq")
    lines.repartition("k").sortWithinPartitions("k", "seq").select("value", "k").write.partitionBy("k").text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
    try:
        numbered = readers.numbered_lines(spark, path)  # writes the lines, split as set here
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    own = F.regexp_extract("value", "#([0-9]+)$", 1).cast("bigint")
    rows = numbered.select(F.floor(own / 5000).alias("k"), (own % 7).alias("s"), F.col("seq").alias("line"))
    return rows.groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"),
                                      F.sum("line").alias("total"))


@query("sc_8_safe_numbers", "sbs_lines", sql="""SELECT seq, TRY_CAST(trim(string_split(value, ',')[12]) AS INTEGER) AS as_int,
    TRY_CAST(nullif(trim(string_split(value, ',')[13]), '') AS DOUBLE) AS as_double FROM sbs_lines""")
def _(t):
    f = F.split("value", ",")
    return t.sbs_lines().select("seq", X.safe_int(F.get(f, F.lit(11))).alias("as_int"), X.safe_double(F.get(f, F.lit(12))).alias("as_double"))


@query("win_9_aircraft_track", "track", gap_us=GAP_US, sql=f"SELECT seq, ts, hex, sighting, {_COLS} FROM track")
def _(t):
    return A.aircraft_track(t.updates(), GAP).select("seq", "ts", "hex", "sighting", *_FIELDS)


@query("agg_7_aircraft_state", "track", gap_us=GAP_US, sql=_STATE + f" SELECT hex, sighting, {_COLS}, seen FROM state")
def _(t):
    return A.aircraft_state(t.updates(), GAP).select("hex", "sighting", *_FIELDS, "seen")


@query("snk_3_live_flights", "track", gap_us=GAP_US, sql=_live("live", NOW) + f" SELECT hex, {_COLS}, seen FROM live")
def _(t):
    return A.live_aircraft(t.updates(), _at(NOW), GAP).select("hex", *_FIELDS, "seen")


@query("agg_6_aircraft_count", "track", gap_us=GAP_US, sql=_STATE + " SELECT count(DISTINCT hex) AS aircraft FROM state WHERE lat <> 0 AND lon <> 0")
def _(t):
    return A.aircraft_count(A.aircraft_state(t.updates(), GAP))


@query("flt_4_positioned", "track", gap_us=GAP_US, sql=_STATE + " SELECT hex, sighting, lat, lon FROM state WHERE lat <> 0 AND lon <> 0")
def _(t):
    return A.positioned(A.aircraft_state(t.updates(), GAP)).select("hex", "sighting", "lat", "lon")


_ALT = "nullif(CAST(floor(nullif(altitude, 0) / 100.0 + 0.5) * 100 AS BIGINT), 0)"


@query("prj_6_aircraft_labels", "track", gap_us=GAP_US, sql=_STATE + f""" SELECT hex, sighting, concat_ws(' ', coalesce(nullif(trim(flight), ''), hex, '???'),
    CASE WHEN {_ALT} >= 10000 THEN 'FL' || ({_ALT} // 100) ELSE {_ALT} || 'ft' END) AS label FROM state""")
def _(t):
    return A.aircraft_labels(A.aircraft_state(t.updates(), GAP)).select("hex", "sighting", "label")


@query("prj_7_aircraft_detail", "track", gap_us=GAP_US, sql=_STATE + f""" SELECT hex, sighting, concat_ws('<br>', '<b>' || coalesce(nullif(trim(flight), ''), hex) || '</b>',
    'ICAO: ' || hex, 'Alt: ' || coalesce(CAST({_ALT} AS VARCHAR), '?'),
    'Spd: ' || coalesce(CAST(CAST(nullif(speed, 0) AS BIGINT) AS VARCHAR) || ' kt', 'n/a'),
    'Hdg: ' || coalesce(CAST(CAST(floor(track + 0.5) AS BIGINT) AS VARCHAR) || '°', 'n/a'),
    'VS: ' || CASE WHEN vert_rate > 0 THEN '+' ELSE '' END || vert_rate || ' fpm', 'Squawk: ' || squawk) AS detail FROM state""")
def _(t):
    return A.aircraft_detail(A.aircraft_state(t.updates(), GAP)).select("hex", "sighting", "detail")


# --- callsigns and correlation --------------------------------------------------------------------

@query("ext_10_callsigns", "utterances", sql=_CALLS + " SELECT transcript_id, pos, callsign FROM calls")
def _(t):
    return _calls(t)


@query("ext_10_callsigns_free_text", "free_text", sql=r"""SELECT text_id, len(regexp_extract_all(text, '\b[A-Z]{3}\s*\d{1,4}\b')) > 0
    OR len(regexp_extract_all(text, '(?i)\bN\d{1,5}[A-Z]{0,2}\b')) > 0 OR regexp_matches(text, '(?i)\b(""" + _NAMES + r""")\s+\d{1,4}\b') AS spoken FROM free_text""")
def _(t):
    return t.free_text().select("text_id", (F.size(A.callsigns("text")) > 0).alias("spoken"))


@query("jn_2_airline_lookup", "utterances", sql=_CALLS + " SELECT substr(callsign, 1, 3) AS code, count(*) AS n FROM calls GROUP BY 1")
def _(t):
    return _calls(t).groupBy(F.substring("callsign", 1, 3).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_8_distinct_in_order", "utterances", sql=_CALLS + " SELECT transcript_id, string_agg(callsign, ',' ORDER BY pos) AS callsigns FROM calls GROUP BY 1")
def _(t):
    return _spoken(t).filter(F.size("callsigns") > 0).select("transcript_id", F.array_join("callsigns", ",").alias("callsigns"))


@query("set_2_pattern_union", "utterances", sql=_CALLS + " SELECT DISTINCT callsign FROM calls")
def _(t):
    return _calls(t).select("callsign").distinct()


def _event_texts(e):
    texts = F.transform("matches", lambda m: F.concat_ws(":", m["hex"], m["matched_callsign"]))
    return e.select("transcript_id", F.size("matches").alias("flights"), F.array_join(texts, ",").alias("matches"))


_ASOF = _CALLS + f""", held AS (SELECT t.transcript_id, t.ts, u.hex, max(u.us) AS us FROM utterances t
    JOIN track u ON u.us BETWEEN t.us - {GAP_US} AND t.us GROUP BY 1, 2, 3),
spoken_of AS (SELECT h.transcript_id, h.ts, h.hex, {", ".join("any_value(u." + c + ") AS " + c for c in _FIELDS)}, any_value(u.ts) AS seen, arg_min(callsign, pos) AS matched_callsign
    FROM held h JOIN track u ON u.hex = h.hex AND u.us = h.us JOIN calls c ON c.transcript_id = h.transcript_id
    WHERE contains(upper(trim(u.flight)), callsign) OR contains(callsign, upper(trim(u.flight))) GROUP BY 1, 2, 3)"""


def _asof(t):
    return A.aircraft_as_of(_spoken(t), A.aircraft_track(t.updates(), GAP), GAP)


@query("jn_4_aircraft_as_of", "track", "utterances", gap_us=GAP_US, sql=_ASOF + f" SELECT transcript_id, ts, hex, {_COLS}, seen, matched_callsign FROM spoken_of")
def _(t):
    return _asof(t)


# JN-3 over every transcript, each with the aircraft in the air at its own moment: the as-of matches, flight by flight.
# The names with ``_as_of`` are the same queries under the names they had before.
_HEARD_BY = _ASOF + ", matched AS (SELECT transcript_id, hex, flight, matched_callsign FROM spoken_of)"


def _matched_as_of(t):
    return A.matched_flights(_asof(t))


@query("jn_3_match_flights_as_of", "track", "utterances", gap_us=GAP_US, sql=_HEARD_BY + " SELECT * FROM matched")
@query("jn_3_match_flights", "track", "utterances", gap_us=GAP_US, sql=_HEARD_BY + " SELECT * FROM matched")
def _(t):
    return _matched_as_of(t)


@query("agg_11_match_events_as_of", "track", "utterances", gap_us=GAP_US, sql=_HEARD_BY + """ SELECT transcript_id, count(*) AS flights,
    string_agg(hex || ':' || matched_callsign, ',' ORDER BY hex) AS matches FROM matched GROUP BY 1""")
@query("agg_11_match_events", "track", "utterances", gap_us=GAP_US, sql=_HEARD_BY + """ SELECT transcript_id, count(*) AS flights,
    string_agg(hex || ':' || matched_callsign, ',' ORDER BY hex) AS matches FROM matched GROUP BY 1""")
def _(t):
    return _event_texts(A.as_of_events(_spoken(t), A.aircraft_track(t.updates(), GAP), GAP))


@query("jn_11_highlightable_as_of", "track", "utterances", gap_us=GAP_US, sql=_HEARD_BY + _live("cur", NOW) + " SELECT * FROM matched WHERE hex IN (SELECT hex FROM cur)")
@query("jn_11_highlightable", "track", "utterances", gap_us=GAP_US, sql=_HEARD_BY + _live("cur", NOW) + " SELECT * FROM matched WHERE hex IN (SELECT hex FROM cur)")
def _(t):
    return A.highlightable(_matched_as_of(t), A.live_aircraft(t.updates(), _at(NOW), GAP)).select("transcript_id", "hex", "flight", "matched_callsign")


@query("ext_13_highlight", "utterances", sql=_CALLS + r""", two AS (SELECT transcript_id, max(callsign) FILTER (pos = 0) AS a, max(callsign) FILTER (pos = 1) AS b FROM calls GROUP BY 1)
    SELECT transcript_id, regexp_replace(regexp_replace(text, '(?i)(' || coalesce(a, '\z.') || ')', '<b>\1</b>', 'g'), '(?i)(' || coalesce(b, '\z.') || ')', '<b>\1</b>', 'g') AS html
    FROM utterances LEFT JOIN two USING (transcript_id)""")
def _(t):
    return _spoken(t).select("transcript_id", T.highlight("text", "callsigns").alias("html"))


@query("jn_8_vanished", "track", gap_us=GAP_US, sql=_live("cur", NOW) + _live("prev", BEFORE) + " SELECT hex FROM prev WHERE hex NOT IN (SELECT hex FROM cur)")
def _(t):
    u = t.updates()
    return A.vanished(A.live_aircraft(u, _at(BEFORE), GAP), A.live_aircraft(u, _at(NOW), GAP)).select("hex")


@query("set_3_snapshot_difference", "track", gap_us=GAP_US, sql=_live("cur", NOW) + _live("prev", BEFORE) + " SELECT hex, flight FROM prev EXCEPT SELECT hex, flight FROM cur")
def _(t):
    u = t.updates()
    prev, cur = (A.live_aircraft(u, _at(x), GAP).select("hex", "flight") for x in (BEFORE, NOW))
    return prev.subtract(cur)


@query("str_10_active_highlights", "track", "utterances", gap_us=GAP_US, sql=_ASOF + f" SELECT transcript_id, hex FROM spoken_of WHERE ts BETWEEN TIMESTAMP '{SOON}' - INTERVAL 10 HOURS AND TIMESTAMP '{SOON}'")
def _(t):
    # the time band of the highlights reaches both sides before they are matched
    since = _at(SOON) - F.expr("INTERVAL 10 HOURS")
    heard = _spoken(t).filter(F.col("ts").between(since, _at(SOON)))
    track = A.aircraft_track(t.updates(), GAP).filter(F.col("ts").between(since - F.expr("INTERVAL 1 DAY"), _at(SOON)))
    return A.active_highlights(A.aircraft_as_of(heard, track, GAP), _at(SOON), 36000).select("transcript_id", "hex")
