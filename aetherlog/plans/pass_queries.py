"""Registered queries: satellite catalogue, passes, recordings, images."""

from __future__ import annotations

from pyspark.sql import functions as F

from aetherlog import dims
from aetherlog.functions import display as D
from aetherlog.operators import passes as P
from aetherlog.plans.registry import query
from aetherlog.session import shared_folder
from aetherlog.sources import readers, recordings

NOW = "2024-01-10 00:00:00"
_US = f"epoch_us(TIMESTAMP '{NOW}')"
KEY = ["station", "satellite"]


def _now():
    return F.lit(NOW).cast("timestamp")


# --- catalogue ----------------------------------------------------------------------------------

# Lines of element files: names, record lines and blanks in the order of the events.
_LINES = """, lines AS (SELECT user_id % 20 AS file, seq AS line_no, CASE
    WHEN c = 0 THEN 'NOAA 15 ' WHEN c = 1 THEN 'NOAA 19 [+]' WHEN c = 2 THEN 'NOAA 18' WHEN c <= 5 THEN '1 ' || seq
    WHEN c = 6 THEN '2 NOAA 15 ' || seq WHEN c <= 8 THEN '2 ' || seq ELSE '  ' END AS value
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) % 10 AS c FROM ev)),
numbered AS (SELECT file, trim(value) AS value, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS pos FROM lines WHERE trim(value) <> ''),
ahead AS (SELECT *, coalesce(starts_with(lead(value, 1) OVER w, '1 ') AND starts_with(lead(value, 2) OVER w, '2 '), false) AS rec,
    lead(value, 1) OVER w AS line1, lead(value, 2) OVER w AS line2 FROM numbered WINDOW w AS (PARTITION BY file ORDER BY pos)),
walk AS (SELECT file, pos, rec FROM ahead WHERE pos = 0
    UNION ALL SELECT a.file, a.pos, a.rec FROM walk w JOIN ahead a ON a.file = w.file AND a.pos = w.pos + CASE WHEN w.rec THEN 3 ELSE 1 END)"""


def _lines(t):
    c = F.round(F.col("value") * 100).cast("bigint") % 10
    seq = F.col("seq").cast("string")
    value = (
        F.when(c == 0, "NOAA 15 ").when(c == 1, "NOAA 19 [+]").when(c == 2, "NOAA 18").when(c <= 5, F.concat(F.lit("1 "), seq))
        .when(c == 6, F.concat(F.lit("2 NOAA 15 "), seq)).when(c <= 8, F.concat(F.lit("2 "), seq)).otherwise("  "))
    return t.events().select((F.col("user_id") % 20).alias("file"), F.col("seq").alias("line_no"), value.alias("value"))


@query("ext_12_parse_tle", "ev", sql="/*RECURSIVE*/" + _LINES + """ SELECT file, CASE WHEN contains(value, 'NOAA 15') THEN 'NOAA 15' ELSE 'NOAA 19' END AS satellite,
    arg_max(line1, a.pos) AS line1, arg_max(line2, a.pos) AS line2 FROM ahead a JOIN walk USING (file, pos) WHERE a.rec AND NOT contains(value, '18')
    AND (contains(value, 'NOAA 15') OR contains(value, 'NOAA 19')) GROUP BY 1, 2""")
def _(t):
    return P.parse_tle(_lines(t))


@query("jn_6_tracked_satellites", "ev", sql=_LINES.split(",\nahead AS")[0] + """ SELECT file, count(*) AS names FROM numbered
    WHERE (contains(value, 'NOAA 15') OR contains(value, 'NOAA 19')) AND NOT contains(value, '18') GROUP BY 1""")
def _(t):
    v = F.col("value")
    tracked = v.contains("NOAA 15") | v.contains("NOAA 19")
    return _lines(t).filter(tracked & ~v.contains(dims.EXCLUDED_NAME_PART)).groupBy("file").agg(F.count(F.lit(1)).alias("names"))


@query("src_3_newest_catalogue", "ev", sql="SELECT user_id % 20 AS file, seq AS copy, ts AS fetched_at FROM ev QUALIFY row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, seq DESC) = 1")
def _(t):
    copies = t.events().select((F.col("user_id") % 20).alias("file"), F.col("seq").alias("copy"), F.col("ts").alias("fetched_at"))
    return readers.newest_per(copies, ["file"], F.struct("fetched_at", "copy"))


@query("flt_11_stale", "ev", sql="""SELECT user_id, fetched_at FROM (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS fetched_at FROM ev GROUP BY 1)
    WHERE fetched_at IS NULL OR epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(fetched_at) > 86400000000""")
def _(t):
    last = t.events().groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("fetched_at"))
    return P.stale(last, F.lit("2024-01-30 12:00:00").cast("timestamp"))


# --- passes ---------------------------------------------------------------------------------------

_P = "station, satellite, aos, los, max_elevation, duration_s"


@query("win_5_detect_passes", "passes", sql=f"SELECT {_P} FROM passes")
def _(t):
    return t.passes()


@query("agg_9_pass_summary", "passes", sql="""SELECT station, satellite, count(*) AS passes, max(max_elevation) AS best, CAST(sum(duration_s) AS BIGINT) AS seconds FROM passes GROUP BY 1, 2""")
def _(t):
    return t.passes().groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("passes"), F.max("max_elevation").alias("best"), F.sum("duration_s").alias("seconds"))


@query("flt_5_high_passes", "passes", sql=f"SELECT {_P} FROM passes WHERE max_elevation >= 20")
def _(t):
    return P.filter_passes(t.passes())


@query("flt_6_passes_within", "passes", sql=f"SELECT {_P} FROM passes WHERE aos_us BETWEEN {_US} AND {_US} + 86400000000")
def _(t):
    return P.passes_within(t.passes(), _now(), 24)


@query("jn_7_with_frequency", "passes", sql="SELECT station, satellite, aos, CASE satellite WHEN 'NOAA 15' THEN '137.6200M' WHEN 'NOAA 19' THEN '137.9125M' ELSE '' END AS frequency FROM passes")
def _(t):
    return P.with_frequency(t.passes()).select(*KEY, "aos", "frequency")


@query("top_1_sorted_passes", "passes", sql=f"SELECT {_P} FROM passes ORDER BY aos, satellite")
def _(t):
    return P.sort_passes(t.passes())


@query("top_2_next_passes", "passes", sql=f"SELECT {_P} FROM passes WHERE aos_us BETWEEN {_US} AND {_US} + 86400000000 ORDER BY aos, satellite, station LIMIT 5")
def _(t):
    return P.next_passes(P.passes_within(t.passes(), _now(), 24), 5, ("station",))


_UPCOMING = ", upcoming AS (SELECT p.*, tick, tick_us, tick_id FROM ticks k JOIN passes p ON k.station = p.station AND aos_us - tick_us > 0 AND aos_us - tick_us <= 600000000)"
_UNTIL = "round((aos_us - tick_us) / 1000000.0::DOUBLE / 60.0::DOUBLE, 1)"


@query("jn_9_upcoming", "passes", "ticks", sql=_UPCOMING + f" SELECT station, satellite, aos, tick_id, {_UNTIL} AS minutes_until FROM upcoming")
def _(t):
    return P.upcoming(t.passes(), t.ticks(), station=["station"]).select(*KEY, "aos", "tick_id", "minutes_until")


@query("sc_16_minutes_until", "passes", "ticks", sql=_UPCOMING + f" SELECT station, satellite, aos, max({_UNTIL}) AS first_notice FROM upcoming GROUP BY 1, 2, 3")
def _(t):
    return P.notices(t.passes(), t.ticks(), station=["station"]).select(*KEY, "aos", F.col("minutes_until").alias("first_notice"))


@query("jn_10_starting", "passes", "ticks", sql="SELECT p.station, satellite, aos, tick_id FROM ticks k JOIN passes p ON k.station = p.station AND abs(aos_us - tick_us) <= 10000000")
def _(t):
    return P.starting(t.passes(), t.ticks(), station=["station"]).select(*KEY, "aos", "tick_id")


def _recordings(busy_s: int) -> str:
    return f"""/*RECURSIVE*/, firsts AS (SELECT station, aos_us, arg_min(satellite, satellite) AS satellite FROM passes GROUP BY 1, 2),
    jumps AS (SELECT *, min(aos_us) OVER (PARTITION BY station ORDER BY aos_us RANGE BETWEEN {busy_s}000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM firsts),
    chain AS (SELECT * FROM jumps WHERE (station, aos_us) IN (SELECT station, min(aos_us) FROM jumps GROUP BY 1)
        UNION ALL SELECT j.* FROM chain c JOIN jumps j ON j.station = c.station AND j.aos_us = c.nxt)
    SELECT station, c.satellite, p.aos, p.max_elevation FROM chain c JOIN passes p USING (station, satellite, aos_us)"""


@query("win_11_select_recordings", "passes", sql=_recordings(900))
def _(t):
    return P.select_recordings(t.passes()).select(*KEY, "aos", "max_elevation")


@query("win_11_long_recordings", "passes", sql=_recordings(21600))
def _(t):
    return P.select_recordings(t.passes(), 21600).select(*KEY, "aos", "max_elevation")


@query("sc_11_elevation_band", "passes", sql="SELECT CASE WHEN max_elevation >= 60 THEN 'high' WHEN max_elevation >= 40 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM passes GROUP BY 1")
def _(t):
    return t.passes().groupBy(D.elevation_band("max_elevation").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("sc_12_minutes", "passes", sql="SELECT station, satellite, aos, CAST(round(duration_s / 60.0::DOUBLE) AS BIGINT) AS minutes FROM passes")
def _(t):
    return t.passes().select(*KEY, "aos", D.minutes("duration_s").alias("minutes"))


_LEFT = f"CAST(floor((aos_us - {_US}) / 1000000.0::DOUBLE) AS BIGINT)"


@query("sc_13_countdown", "passes", sql=f"""SELECT station, satellite, aos, CASE WHEN s <= 0 THEN 'NOW' ELSE CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' ELSE '' END
    || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS countdown FROM (SELECT *, {_LEFT} AS s FROM passes)""")
def _(t):
    return t.passes().select(*KEY, "aos", D.countdown("aos", _now()).alias("countdown"))


@query("sc_14_progress", "passes", sql=f"""SELECT station, satellite, aos, round(least(100.0, ({_US} - aos_us) / 1000000.0::DOUBLE / 86400.0 * 100.0), 3) AS pct FROM passes""")
def _(t):
    return t.passes().select(*KEY, "aos", F.round(D.progress_pct("aos", F.lit(86400.0), _now()), 3).alias("pct"))


@query("sc_15_relative_time", "passes", sql=f"""SELECT station, satellite, aos, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || ' min ago' ELSE (s // 3600) || 'h ago' END AS rel
    FROM (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - aos_us) / 1000000.0::DOUBLE) AS BIGINT) AS s FROM passes)""")
def _(t):
    return t.passes().select(*KEY, "aos", D.relative_time("aos", F.lit("2024-02-01").cast("timestamp")).alias("rel"))


@query("sc_18_pass_key", "passes", sql="SELECT station, satellite || '_' || strftime(aos, '%Y-%m-%dT%H:%M:%S.%fZ') AS pass_key FROM passes")
def _(t):
    return t.passes().select("station", D.pass_key("satellite", "aos").alias("pass_key"))


@query("sc_20_safe_name", "passes", sql="SELECT replace(satellite, ' ', '-') AS safe_name, count(*) AS n FROM passes GROUP BY 1")
def _(t):
    return t.passes().groupBy(D.safe_name("satellite").alias("safe_name")).agg(F.count(F.lit(1)).alias("n"))


# --- images -------------------------------------------------------------------------------------------

_IMG = ["image_id", "filename", "satellite", "pass_time", "pass_ts", "url"]


@query("src_5_image_listing", "image_files", sql="SELECT image_id, path FROM image_files WHERE path LIKE '%.png'")
def _(t):
    return t.images().filter(F.col("path").endswith(".png")).select("image_id", "path")


@query("src_5_image_files", "image_files", sql="""SELECT DISTINCT replace(split_part(f, '_', 1), '-', ' ') AS satellite, split_part(f, '_', 2) AS pass_time, '/static/images/apt/' || f || '.png' AS url
    FROM (SELECT substr(split_part(path, '/', -1), 1, 21) || '00Z' AS f FROM image_files)""")
def _(t):
    """One image file a satellite and hour, beside files of other kinds, listed by the reader without reading any."""
    path = shared_folder(t.spark, "images")
    names = t.images().select(F.concat(F.substring(F.element_at(F.split("path", "/"), -1), 1, 21), F.lit("00Z")).alias("name")).distinct()
    files = names.withColumn("content", F.encode("name", "UTF-8"))
    recordings.write_recordings(files, path, "name", suffix=".png")
    recordings.write_recordings(files.filter(F.col("name").contains("T00")), path, "name", suffix=".wav")
    return P.parse_image_name(readers.read_images(t.spark, path)).select("satellite", "pass_time", "url")


@query("prj_2_image_names", "images", sql=f"SELECT {', '.join(_IMG)} FROM images")
def _(t):
    return P.parse_image_name(t.images()).select(*_IMG)


@query("top_3_latest_image", "images", sql="SELECT filename, satellite, pass_time, url FROM images ORDER BY filename DESC LIMIT 1")
def _(t):
    return P.latest_image(P.parse_image_name(t.images())).select("filename", "satellite", "pass_time", "url")


@query("top_3_latest_image_by_time", "images", sql="SELECT filename, satellite, pass_time, url FROM images ORDER BY pass_ts DESC, filename DESC LIMIT 1")
def _(t):
    return P.latest_image(P.parse_image_name(t.images()), "time").select("filename", "satellite", "pass_time", "url")


@query("top_4_image_history", "images", sql="SELECT filename, satellite, pass_time, url FROM images ORDER BY filename DESC LIMIT 5")
def _(t):
    return P.image_history(P.parse_image_name(t.images()), 5).select("filename", "satellite", "pass_time", "url")


@query("jn_13_images_with_pass", "images", "passes", sql="""SELECT i.image_id, i.filename, coalesce(arg_max(p.max_elevation, p.aos_us), 0.0) AS max_elevation, '47.67N, 122.12W' AS location
    FROM images i LEFT JOIN passes p ON p.station = i.station AND p.satellite = i.satellite
    AND epoch_us(i.pass_ts) BETWEEN p.aos_us - 120000000 AND p.los_us GROUP BY 1, 2""")
def _(t):
    images = P.parse_image_name(t.images()).select("station", "satellite", "image_id", "filename", "pass_ts")
    return P.images_with_pass(images, t.passes(), KEY, "47.67N, 122.12W").select("image_id", "filename", "max_elevation", "location")
