"""Radio inputs derived from the given tables.

The given tables hold no radio data, so each registered query derives its
input from whole tables by rules DuckDB can repeat. ``Tables`` holds the Spark
side, ``CTES`` the SQL side of the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aetherlog import dims
from aetherlog.plans.blocked import numbered, time_block
from aetherlog.sources import readers

_AIRLINE_NAMES = list(dims.AIRLINES)
_CODES = ["ASA", "UAL", "DAL", "AAL", "SWA", "JBU", "QXE", "SKW", "FFT", "NKS", "HAL"]
_DIRECTIONS = ["north", "south", "east", "west", "northwest", "northeast", "southwest", "southeast"]
_VISIBILITY = ["10 miles", "2 to 4 miles", "one quarter mile", "one half mile", "three miles", "some miles"]
_PLACES = ["puget sound", "the cascades passes", "coastal waters", "admiralty inlet", "skagit", "the region"]
_PERIODS = ["tonight", "tomorrow", "this evening", "saturday", "friday"]
_KINDS = [
    "advisory", "warning", "watch", "none",
]


def _pick(words: list[str], index: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def _sql_pick(words: list[str], index: str) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"list_extract([{listed}], CAST({index} % {len(words)} + 1 AS INTEGER))"


class Tables:
    """Derived inputs over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def events(self) -> DataFrame:
        return derive_events(self.read("events"))

    def presets(self) -> DataFrame:
        return readers.presets(self.spark)

    def categories(self) -> DataFrame:
        return readers.categories(self.spark)

    def frames(self) -> DataFrame:
        """Long streams: one per event type; the value is the frame energy."""
        e = self.events().select(F.col("event_type").alias("stream_id"), "ts", "seq", "value")
        n = numbered(e, ["stream_id"], ["ts", "seq"], time_block("ts"), "frame_idx")
        return n.select(
            "stream_id", "frame_idx", F.lit(dims.FRAME_SAMPLES).alias("n"),
            (F.col("value") * F.col("value") * dims.FRAME_SAMPLES).alias("sumsq"), F.col("value").alias("rms"))

    def sbs_lines(self) -> DataFrame:
        return derive_sbs_lines(self.events())

    def updates(self) -> DataFrame:
        from aetherlog.operators.aviation import parse_sbs

        return parse_sbs(self.sbs_lines())

    def utterances(self) -> DataFrame:
        return derive_utterances(self.read("orders"))

    def weather(self) -> DataFrame:
        return derive_weather(self.read("orders"))

    def samples(self) -> DataFrame:
        """Look angles: a station per event type, two satellites."""
        e = self.events()
        return e.select(
            F.col("event_type").alias("station"),
            F.when(F.col("user_id") % 2 == 0, "NOAA 15").otherwise("NOAA 19").alias("satellite"),
            "ts", "seq", (F.floor(F.col("value") * 10) / 10.0 - 30.0).alias("elevation"))

    def passes(self) -> DataFrame:
        from aetherlog.operators.passes import detect_passes

        return detect_passes(self.samples(), ["station", "satellite"], order=["seq"])

    def ticks(self) -> DataFrame:
        """Clock ticks of each station, on the grid of the pass check: the slots in which it has events."""
        from aetherlog.operators.passes import tick_grid

        return tick_grid(derive_ticks(self.events()), ["station"]).withColumnRenamed("slot", "tick_id")

    def images(self) -> DataFrame:
        e = self.events()
        sat = F.when(F.col("user_id") % 2 == 0, "NOAA-15").otherwise("NOAA-19")
        return e.select(
            F.col("event_type").alias("station"), F.col("seq").alias("image_id"),
            F.concat(F.lit("/data/apt/"), sat, F.lit("_"), F.date_format("ts", "yyyy-MM-dd'T'HHmm'Z'"), F.lit(".png")).alias("path"))

    def status(self) -> DataFrame:
        return derive_status(self.events())

    def health(self) -> DataFrame:
        e = self.events()
        t = F.col("event_type")
        kind = F.when(t == "error", "crash").when(t == "signup", "reconnect").otherwise("ok")
        return e.select((F.col("user_id") % 20).alias("station"), "ts", "seq", kind.alias("kind"))

    def tune_events(self) -> DataFrame:
        e = self.events()
        t = F.col("event_type")
        kind = (F.when(t == "purchase", "tune").when(t == "error", "stop")
                .when(t == "signup", "apt_enter").when(t == "view", "apt_exit").otherwise("note"))
        return e.select((F.col("user_id") % 20).alias("station"), "ts", "seq", kind.alias("kind"),
                        F.when(t == "purchase", preset_of(F.col("seq"))).alias("preset_id"))

    def inference_log(self) -> DataFrame:
        e = self.events()
        return e.select(
            F.col("user_id").alias("stream_id"), "ts", "seq", (F.col("event_type") == "view").alias("skipped"),
            (F.floor("value") % 33).cast("int").alias("tokens"),
            F.when(F.col("seq") % 7 == 0, 0.0).otherwise(F.floor(F.col("value") * 4) / 8).alias("encoder_ms"),
            F.when(F.col("seq") % 11 == 0, 0.0).otherwise(F.floor(F.col("value") * 4) / 4).alias("decoder_ms"),
            (F.col("seq") % 16).cast("double").alias("audio_s"),
            F.when(F.col("seq") % 3 == 0, "hailo").when(F.col("seq") % 3 == 1, "cpu").otherwise("none").alias("backend"))

    def recordings(self) -> DataFrame:
        """Bytes of every document text, taken as 16-bit samples."""
        d = self.read("documents")
        return d.select(F.col("doc_id").alias("stream_id"), F.encode("text", "UTF-8").alias("content"))

    def free_text(self) -> DataFrame:
        """Whole conversation turns and documents, and each turn's opening words."""
        c, d = self.read("conversations"), self.read("documents")
        turn = F.concat_ws("-", F.lit("c"), "conv_id", "turn")
        first = F.element_at(F.split("text", " "), 1)
        a = c.select(turn.alias("text_id"), "text")
        b = c.select(F.concat(turn, F.lit("-w")).alias("text_id"), F.concat(F.lit("\t"), first, F.lit(" ")).alias("text"))
        g = c.select(F.concat(turn, F.lit("-r")).alias("text_id"), F.concat(F.repeat(F.concat(F.substring("text", 1, 2), F.lit("-")), 3)).alias("text"))
        h = c.select(F.concat(turn, F.lit("-b")).alias("text_id"), F.concat(F.lit("["), first, F.lit(")")).alias("text"))
        return a.union(b).union(g).union(h).union(d.select(F.concat_ws("-", F.lit("d"), "doc_id").alias("text_id"), "text"))


# Derivations that batch and streaming queries share take the table as an argument.

def derive_events(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


def derive_ticks(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_type").alias("station"), F.col("ts").alias("tick"))


def preset_of(n: F.Column) -> F.Column:
    """A preset id; every 16th is one that does not exist."""
    return _pick([p[0] for p in dims.PRESETS] + ["no-such-preset"], n)


def derive_sbs_lines(e: DataFrame) -> DataFrame:
    t, seq, user = F.col("event_type"), F.col("seq"), F.col("user_id")
    cents = F.round(F.col("value") * 100).cast("bigint")

    def only(kind: str, value: F.Column) -> F.Column:
        return F.when(t == kind, value.cast("string")).otherwise("")

    made = F.date_format("ts", "yyyy/MM/dd,HH:mm:ss.SSS")
    two = F.lpad((seq % 100).cast("string"), 2, "0")
    fields = [
        F.when(seq % 50 == 0, "STA").otherwise("MSG"), F.lit("3,1,1"),
        F.when(seq % 50 == 2, "").otherwise(F.concat(F.lit(" "), F.lower(F.lpad(F.hex(user), 6, "a")))),
        F.concat(F.lit("1,"), made, F.lit(","), made),
        only("signup", F.concat(_pick(_CODES, user), (100 + user % 9000).cast("string"), F.lit("  "))),
        F.when(seq % 50 == 3, "abc").otherwise(only("click", cents)),
        only("view", F.floor(cents / 10)),
        only("error", seq % 360),
        only("purchase", F.concat(F.lit("47."), two)),
        F.when(seq % 50 == 4, "").otherwise(only("purchase", F.concat(F.lit("-122."), two))),
        only("view", seq % 4001 - 2000), only("error", 1000 + seq % 6000),
    ]
    line = F.when(seq % 50 == 1, F.lit("MSG,3,1,1,ABC,1,a,b")).otherwise(F.concat_ws(",", *fields))
    return e.select(line.alias("value"), "ts", "seq")


def _minute_of_january(n: F.Column) -> F.Column:
    """A minute of the 30 days the events cover."""
    return F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(n % 43200).cast("int"))


def derive_utterances(orders: DataFrame) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    v = F.floor(c / 10)  # ten customers speak of one user's flight
    num, num2 = (100 + v % 9000).cast("string"), (o % 97 + 1).cast("string")
    who, who2 = _pick(_AIRLINE_NAMES, v), _pick(_AIRLINE_NAMES, c + 3)
    text = (
        F.when(o % 4 == 0, F.concat(who, F.lit(" "), num, F.lit(" cleared to land runway 34 left")))
        .when(o % 4 == 1, F.concat(_pick(_CODES, v), F.lit(" "), num, F.lit(" turn left heading 270")))
        .when(o % 4 == 2, F.concat(F.lit("N"), num, F.lit("ab contact tower")))
        .otherwise(F.concat(F.upper(who), F.lit(" "), num, F.lit(" follow "), who2, F.lit(" "), num2)))
    ts = _minute_of_january(o)
    return orders.select(
        o.alias("transcript_id"), (c % 10).alias("stream_id"), ts.alias("ts"), text.alias("text"))


def derive_weather(orders: DataFrame) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    temp = F.when(o % 5 == 0, "conditions unknown ").when(o % 5 == 1, F.concat(F.lit("Currently "), (c % 100).cast("string"), F.lit(" ")))
    temp = temp.otherwise(F.concat(F.lit("Temperature is "), (c % 100).cast("string"), F.lit(" degrees ")))
    way, spd = _pick(_DIRECTIONS, o), (o % 40).cast("string")
    unit = _pick(["miles per hour", "mph", "knots", "knts"], c)
    wind = (
        F.when(o % 3 == 0, F.concat(F.lit("winds "), way, F.lit(" at "), spd, F.lit(" "), unit))
        .when(o % 3 == 1, F.concat(way, F.lit(" winds "), spd, F.lit(" to "), (o % 40 + 5).cast("string"), F.lit(" "), unit))
        .otherwise("winds light and variable"))
    alert = F.concat(
        _pick([p for p, _ in dims.ALERT_RULES] + ["calm"], o), F.when(o % 7 == 0, "  ").otherwise(" "), _pick(_KINDS, c))
    text = F.concat(
        temp, wind, F.lit(" visibility "), _pick(_VISIBILITY, o * 3 + c), F.lit(" "), alert, F.lit(" for "),
        _pick(_PLACES, o), F.lit(" "), _pick(_PERIODS, o), F.lit(" rain likely "), _pick(_PERIODS, c),
        F.lit(" fair skies "), _pick(_PLACES, c), F.lit(" seas 3 to 5 feet"))
    text = F.when(o % 6 == 0, F.concat(F.lit("\t"), text, F.lit("  "))).otherwise(text)
    ts = _minute_of_january(o)
    return orders.select(
        o.alias("transcript_id"), (c % 10).cast("string").alias("stream_id"), ts.alias("ts"), preset_of(c).alias("preset_id"),
        F.when(o % 2 == 0, "SDR").otherwise("WEBSTREAM").alias("source"), text.alias("text"))


def derive_status(e: DataFrame) -> DataFrame:
    t, seq = F.col("event_type"), F.col("seq")
    return e.select(
        (F.col("user_id") % 20).alias("station"), "ts", "seq", (t != "error").alias("running"),
        (~t.isin("error", "signup")).alias("sdr_connected"), preset_of(seq).alias("preset_id"),
        _pick(["am", "fm", "wbfm", "adsb", ""], F.col("user_id")).alias("mode"),
        (seq % 200 - 50).cast("int").alias("squelch"),
        F.when(seq % 3 == 0, "").when(seq % 3 == 1, "1M").alias("sample_rate"),
        F.when(seq % 4 == 0, True).when(seq % 4 == 1, False).alias("deemp"),
        (seq % 5 != 0).alias("adsb_enabled"))


# --- the same rules in SQL ----------------------------------------------------------------------

_PRESET_ROWS = ",\n".join(
    "(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row) + ")"
    for row in dims.PRESETS)
_PRESET_IDS = [p[0] for p in dims.PRESETS] + ["no-such-preset"]

_ONLY = "CASE WHEN event_type = '{0}' THEN CAST({1} AS VARCHAR) ELSE '' END"

CTES: dict[str, tuple[list[str], str]] = {
    "presets": ([], "SELECT * FROM (VALUES " + _PRESET_ROWS + ") AS p(id, label, freq, mode, category, squelch, parser, stream_url, device_index)"),
    "categories": ([], "SELECT * FROM (VALUES " + ", ".join(
        f"('{c}', {i}, '{label}')" for i, (c, label) in enumerate(dims.CATEGORIES)) + ") AS c(category, ord, category_label)"),
    "ev": ([], "SELECT event_id AS seq, ts, epoch_us(ts) AS us, user_id, event_type, value, props FROM events"),
    "frames": (["ev"], """SELECT event_type AS stream_id,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, seq) - 1 AS frame_idx,
        1600 AS n, value * value * 1600 AS sumsq, value AS rms FROM ev"""),
    "sbs_lines": (["ev"], f"""SELECT CASE WHEN seq % 50 = 1 THEN 'MSG,3,1,1,ABC,1,a,b' ELSE concat_ws(',',
        CASE WHEN seq % 50 = 0 THEN 'STA' ELSE 'MSG' END, '3,1,1',
        CASE WHEN seq % 50 = 2 THEN '' ELSE ' ' || lower(lpad(hex(user_id), 6, 'a')) END,
        '1,' || strftime(ts, '%Y/%m/%d,%H:%M:%S.%g') || ',' || strftime(ts, '%Y/%m/%d,%H:%M:%S.%g'),
        {_ONLY.format('signup', _sql_pick(_CODES, 'user_id') + " || CAST(100 + user_id % 9000 AS VARCHAR) || '  '")},
        CASE WHEN seq % 50 = 3 THEN 'abc' ELSE {_ONLY.format('click', 'cents')} END,
        {_ONLY.format('view', 'cents // 10')}, {_ONLY.format('error', 'seq % 360')},
        {_ONLY.format('purchase', "'47.' || lpad(CAST(seq % 100 AS VARCHAR), 2, '0')")},
        CASE WHEN seq % 50 = 4 THEN '' ELSE {_ONLY.format('purchase', "'-122.' || lpad(CAST(seq % 100 AS VARCHAR), 2, '0')")} END,
        {_ONLY.format('view', 'seq % 4001 - 2000')}, {_ONLY.format('error', '1000 + seq % 6000')}) END AS value, ts, us, seq
        FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM ev)"""),
    "updates": (["sbs_lines"], """SELECT ts, us, seq, upper(trim(f[5])) AS hex, nullif(trim(f[11]), '') AS flight,
        TRY_CAST(nullif(trim(f[12]), '') AS INTEGER) AS altitude, TRY_CAST(nullif(trim(f[13]), '') AS DOUBLE) AS speed,
        TRY_CAST(nullif(trim(f[14]), '') AS DOUBLE) AS track,
        CASE WHEN trim(f[15]) <> '' AND trim(f[16]) <> '' THEN CAST(f[15] AS DOUBLE) END AS lat,
        CASE WHEN trim(f[15]) <> '' AND trim(f[16]) <> '' THEN CAST(f[16] AS DOUBLE) END AS lon,
        TRY_CAST(nullif(trim(f[17]), '') AS INTEGER) AS vert_rate, nullif(trim(f[18]), '') AS squawk
        FROM (SELECT *, string_split(value, ',') AS f FROM sbs_lines)
        WHERE f[1] = 'MSG' AND len(f) >= 11 AND trim(f[5]) <> ''"""),
    "sighted": (["updates"], """SELECT *, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY hex ORDER BY us, seq) AS BIGINT) AS sighting
        FROM (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY hex ORDER BY us, seq) > {gap_us}, true) AS fresh FROM updates)"""),
    "track": (["sighted"], "SELECT ts, us, seq, hex, sighting, " + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ["flight", "altitude", "speed", "track", "lat", "lon", "vert_rate", "squawk"]
    ) + " FROM sighted WINDOW w AS (PARTITION BY hex, sighting ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "utterances": ([], f"""SELECT o_orderkey AS transcript_id, o_custkey % 10 AS stream_id,
        to_timestamp(1704067200 + (o_orderkey % 43200) * 60) AT TIME ZONE 'UTC' AS ts, (1704067200 + (o_orderkey % 43200) * 60) * 1000000 AS us,
        CASE o_orderkey % 4
        WHEN 0 THEN {_sql_pick(_AIRLINE_NAMES, '(o_custkey // 10)')} || ' ' || num || ' cleared to land runway 34 left'
        WHEN 1 THEN {_sql_pick(_CODES, '(o_custkey // 10)')} || ' ' || num || ' turn left heading 270'
        WHEN 2 THEN 'N' || num || 'ab contact tower'
        ELSE upper({_sql_pick(_AIRLINE_NAMES, '(o_custkey // 10)')}) || ' ' || num || ' follow ' || {_sql_pick(_AIRLINE_NAMES, '(o_custkey + 3)')} || ' ' || CAST(o_orderkey % 97 + 1 AS VARCHAR)
        END AS text
        FROM (SELECT *, CAST(100 + (o_custkey // 10) % 9000 AS VARCHAR) AS num FROM orders)"""),
    "weather": ([], f"""SELECT o_orderkey AS transcript_id, CAST(o_custkey % 10 AS VARCHAR) AS stream_id,
        to_timestamp(1704067200 + (o_orderkey % 43200) * 60) AT TIME ZONE 'UTC' AS ts, {_sql_pick(_PRESET_IDS, 'o_custkey')} AS preset_id,
        CASE WHEN o_orderkey % 2 = 0 THEN 'SDR' ELSE 'WEBSTREAM' END AS source,
        CASE WHEN o_orderkey % 6 = 0 THEN chr(9) ELSE '' END ||
        CASE o_orderkey % 5 WHEN 0 THEN 'conditions unknown ' WHEN 1 THEN 'Currently ' || CAST(o_custkey % 100 AS VARCHAR) || ' '
        ELSE 'Temperature is ' || CAST(o_custkey % 100 AS VARCHAR) || ' degrees ' END ||
        CASE o_orderkey % 3 WHEN 0 THEN 'winds ' || way || ' at ' || spd || ' ' || unit
        WHEN 1 THEN way || ' winds ' || spd || ' to ' || CAST(o_orderkey % 40 + 5 AS VARCHAR) || ' ' || unit
        ELSE 'winds light and variable' END ||
        ' visibility ' || {_sql_pick(_VISIBILITY, '(o_orderkey * 3 + o_custkey)')} || ' ' ||
        {_sql_pick([p for p, _ in dims.ALERT_RULES] + ['calm'], 'o_orderkey')} ||
        CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE ' ' END || {_sql_pick(_KINDS, 'o_custkey')} || ' for ' ||
        {_sql_pick(_PLACES, 'o_orderkey')} || ' ' || {_sql_pick(_PERIODS, 'o_orderkey')} || ' rain likely ' ||
        {_sql_pick(_PERIODS, 'o_custkey')} || ' fair skies ' || {_sql_pick(_PLACES, 'o_custkey')} || ' seas 3 to 5 feet' ||
        CASE WHEN o_orderkey % 6 = 0 THEN '  ' ELSE '' END AS text
        FROM (SELECT *, {_sql_pick(_DIRECTIONS, 'o_orderkey')} AS way, CAST(o_orderkey % 40 AS VARCHAR) AS spd,
        {_sql_pick(['miles per hour', 'mph', 'knots', 'knts'], 'o_custkey')} AS unit FROM orders)"""),
    "low": (["weather"], "SELECT *, lower(text) AS t FROM weather"),
    "samples": (["ev"], """SELECT event_type AS station, CASE WHEN user_id % 2 = 0 THEN 'NOAA 15' ELSE 'NOAA 19' END AS satellite,
        ts, us, seq, floor(value * 10) / 10.0::DOUBLE - 30.0::DOUBLE AS elevation FROM ev"""),
    "passes": (["samples"], """SELECT station, satellite, min(ts) AS aos, max(ts) AS los, min(us) AS aos_us, max(us) AS los_us,
        round(max(elevation), 1) AS max_elevation, CAST(round((max(us) - min(us)) / 1000000) AS BIGINT) AS duration_s
        FROM (SELECT *, sum(CASE WHEN up AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY station, satellite ORDER BY us, seq) AS island
              FROM (SELECT *, elevation > 0 AS up,
                    coalesce(lag(elevation > 0) OVER (PARTITION BY station, satellite ORDER BY us, seq), false) AS was FROM samples))
        WHERE up GROUP BY station, satellite, island"""),
    "ticks": (["ev"], "SELECT DISTINCT event_type AS station, us // 30000000 AS tick_id, us // 30000000 * 30000000 AS tick_us, make_timestamp(us // 30000000 * 30000000) AS tick FROM ev"),
    "image_files": (["ev"], """SELECT event_type AS station, seq AS image_id, '/data/apt/' || CASE WHEN user_id % 2 = 0 THEN 'NOAA-15' ELSE 'NOAA-19' END
        || '_' || strftime(ts, '%Y-%m-%dT%H%MZ') || '.png' AS path FROM ev"""),
    "images": (["image_files"], """SELECT station, image_id, path, filename, replace(split_part(stem, '_', 1), '-', ' ') AS satellite,
        CASE WHEN strpos(stem, '_') > 0 THEN substr(stem, strpos(stem, '_') + 1) ELSE '' END AS pass_time,
        '/static/images/apt/' || filename AS url,
        strptime(substr(stem, strpos(stem, '_') + 1), '%Y-%m-%dT%H%MZ') AS pass_ts
        FROM (SELECT *, replace(filename, '.png', '') AS stem FROM (SELECT *, split_part(path, '/', -1) AS filename FROM image_files))"""),
    "status": (["ev"], f"""SELECT user_id % 20 AS station, ts, us, seq, event_type <> 'error' AS running,
        event_type NOT IN ('error', 'signup') AS sdr_connected, {_sql_pick(_PRESET_IDS, 'seq')} AS preset_id,
        {_sql_pick(['am', 'fm', 'wbfm', 'adsb', ''], 'user_id')} AS mode, CAST(seq % 200 - 50 AS INTEGER) AS squelch,
        CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN '1M' END AS sample_rate,
        CASE seq % 4 WHEN 0 THEN true WHEN 1 THEN false END AS deemp, seq % 5 <> 0 AS adsb_enabled FROM ev"""),
    "health": (["ev"], """SELECT user_id % 20 AS station, ts, us, seq,
        CASE event_type WHEN 'error' THEN 'crash' WHEN 'signup' THEN 'reconnect' ELSE 'ok' END AS kind FROM ev"""),
    "tune_events": (["ev"], f"""SELECT user_id % 20 AS station, ts, us, seq, CASE event_type WHEN 'purchase' THEN 'tune' WHEN 'error' THEN 'stop'
        WHEN 'signup' THEN 'apt_enter' WHEN 'view' THEN 'apt_exit' ELSE 'note' END AS kind,
        CASE WHEN event_type = 'purchase' THEN {_sql_pick(_PRESET_IDS, 'seq')} END AS preset_id FROM ev"""),
    "inference_log": (["ev"], """SELECT user_id AS stream_id, ts, us, seq, event_type = 'view' AS skipped,
        CAST(CAST(floor(value) AS BIGINT) % 33 AS INTEGER) AS tokens,
        CASE WHEN seq % 7 = 0 THEN 0.0::DOUBLE ELSE floor(value * 4) / 8 END AS encoder_ms,
        CASE WHEN seq % 11 = 0 THEN 0.0::DOUBLE ELSE floor(value * 4) / 4 END AS decoder_ms,
        CAST(seq % 16 AS DOUBLE) AS audio_s,
        CASE seq % 3 WHEN 0 THEN 'hailo' WHEN 1 THEN 'cpu' ELSE 'none' END AS backend FROM ev"""),
    "free_text": ([], r"""SELECT 'c-' || conv_id || '-' || turn AS text_id, text FROM conversations
        UNION ALL SELECT 'c-' || conv_id || '-' || turn || '-w', chr(9) || split_part(text, ' ', 1) || ' ' FROM conversations
        UNION ALL SELECT 'c-' || conv_id || '-' || turn || '-r', repeat(substr(text, 1, 2) || '-', 3) FROM conversations
        UNION ALL SELECT 'c-' || conv_id || '-' || turn || '-b', '[' || split_part(text, ' ', 1) || ')' FROM conversations
        UNION ALL SELECT 'd-' || doc_id, text FROM documents"""),
}


def with_ctes(body: str, *names: str, gap_us: int = 86400 * 1000000) -> str:
    """A query with the derived inputs it names, and theirs, as leading CTEs."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name not in ordered:
            for dep in CTES[name][0]:
                need(dep)
            ordered.append(name)

    for n in names:
        need(n)
    parts = [f"{n} AS ({CTES[n][1].replace('{gap_us}', str(gap_us))})" for n in ordered]
    head = "WITH RECURSIVE " if "RECURSIVE" in body else "WITH "
    extra = body.replace("/*RECURSIVE*/", "")
    if extra.lstrip().startswith(","):
        return head + ",\n".join(parts) + extra
    return head + ",\n".join(parts) + "\n" + extra
