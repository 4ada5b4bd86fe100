"""Telemetry parsing, aircraft state, callsigns, and their correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aetherlog import dims
from aetherlog.functions.display import micros
from aetherlog.functions.text import SPACE, rx_all, safe_double, strip_ws
from aetherlog.plans.blocked import carry_in_sessions, time_block
from aetherlog.plans.store import stored
from aetherlog.session import session_with

STATE_FIELDS = ["flight", "altitude", "speed", "track", "position", "vert_rate", "squawk"]


def parse_sbs(lines: DataFrame, value: str = "value") -> DataFrame:
    """Telemetry lines to typed updates; a bad or missing number is NULL, never an error."""
    fields = {"hex": 4, "flight": 10, "altitude": 11, "speed": 12, "track": 13, "lat": 14, "lon": 15, "vert_rate": 16, "squawk": 17}
    keep = [c for c in lines.columns if c != value]
    # one look at each line: a message, a non-blank aircraft id, at least 11 fields
    usable = rf"^MSG,(?:[^,]*,){{3}}{SPACE}*[^,{SPACE[1:-1]}][^,]*(?:,[^,]*){{6}}"
    # the split and the trims get columns of their own, so that each runs once per line
    split = lines.filter(F.col(value).rlike(usable)).select(*keep, F.split(F.col(value), ",").alias("_f"))
    text = split.select(*keep, *[strip_ws(F.get("_f", F.lit(i))).alias(n) for n, i in fields.items()])
    typed = text.select(
        *keep, F.upper("hex").alias("hex"), _given("flight").alias("flight"),
        _given("altitude").try_cast("int").alias("altitude"), safe_double("speed").alias("speed"),
        safe_double("track").alias("track"), safe_double("lat").alias("lat"), safe_double("lon").alias("lon"),
        _given("vert_rate").try_cast("int").alias("vert_rate"), _given("squawk").alias("squawk"))
    # a position needs both numbers
    return typed.withColumns({
        "lat": F.when(F.col("lon").isNotNull(), F.col("lat")), "lon": F.when(F.col("lat").isNotNull(), F.col("lon"))})


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


# --- state ---------------------------------------------------------------------------

def _with_position(updates: DataFrame) -> DataFrame:
    pos = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    return updates.withColumn("position", pos)


def sightings(updates: DataFrame, gap_s: int = dims.AIRCRAFT_TTL_S, block_s: int = 3600) -> DataFrame:
    """Number the sightings of each aircraft; a silence longer than the gap starts a new one."""
    return carry_in_sessions(
        updates, ["hex"], ["ts", "seq"], micros("ts"), gap_s * 1000000, time_block("ts", block_s), "sighting", {})


def merge_state(updates: DataFrame, key: list[str]) -> DataFrame:
    """Newest non-empty value of every field per key; partial sums travel, not rows."""
    order = F.struct("ts", "seq")
    rows = _with_position(updates)
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in STATE_FIELDS]
    merged = rows.groupBy(*key).agg(*newest, F.max("ts").alias("seen"))
    return merged.select(
        *key, "flight", "altitude", "speed", "track", "position.lat", "position.lon",
        "vert_rate", "squawk", "seen")


def aircraft_state(updates: DataFrame, gap_s: int = dims.AIRCRAFT_TTL_S, block_s: int = 3600) -> DataFrame:
    """State at the end of every sighting of every aircraft."""
    return merge_state(sightings(updates, gap_s, block_s), ["hex", "sighting"])


def live_aircraft(updates: DataFrame, as_of: Column, ttl_s: int = dims.AIRCRAFT_TTL_S, block_s: int | None = None) -> DataFrame:
    """The aircraft table at a moment: the open sighting of each aircraft not yet expired.

    Updates of a span of ``ttl_s`` seconds belong to one sighting, so those of each aircraft are merged before anything is shuffled, and
    sightings are told apart on these summaries. Only aircraft seen in the last ``ttl_s`` seconds can be in the table. A smaller
    ``block_s`` makes the spans shorter.
    """
    at, order, span = micros("ts"), F.struct("ts", "seq"), max(min(block_s or ttl_s, ttl_s), 1)
    rows = _with_position(updates.filter((F.col("ts") <= as_of) & F.col("hex").isNotNull()))
    newest = [F.max_by(F.struct(F.col(c).alias("v"), order.alias("at")), F.when(F.col(c).isNotNull(), order)).alias(c) for c in STATE_FIELDS]
    spans = rows.groupBy("hex", time_block("ts", span).alias("_span")).agg(
        *newest, F.min(at).alias("_first"), F.max(at).alias("_last"), F.max("ts").alias("seen"))
    # newest first: the open sighting has the spans with no beginning of a sighting after them
    newer = Window.partitionBy("hex").orderBy(F.desc("_span"))
    gap = F.col("_first") - F.lead("_last").over(newer) > ttl_s * 1000000
    placed = spans.withColumns({"_opens": F.coalesce(gap.cast("int"), F.lit(0)), "_end": F.first("_last").over(newer)})
    after = F.sum("_opens").over(newer.rowsBetween(Window.unboundedPreceding, -1))
    still = placed.withColumn("_after", after).filter(
        (F.coalesce("_after", F.lit(0)) == 0) & (micros(as_of) - F.col("_end") <= ttl_s * 1000000))
    merged = still.groupBy("hex").agg(*[F.max_by(f"{c}.v", f"{c}.at").alias(c) for c in STATE_FIELDS], F.max("seen").alias("seen"))
    return merged.select("hex", "flight", "altitude", "speed", "track", "position.lat", "position.lon", "vert_rate", "squawk", "seen")


def aircraft_track(updates: DataFrame, gap_s: int = dims.AIRCRAFT_TTL_S, block_s: int = 3600) -> DataFrame:
    """The full state after every update: each field carried forward within its sighting."""
    rows = _with_position(updates).drop("lat", "lon")
    filled = carry_in_sessions(
        rows, ["hex"], ["ts", "seq"], micros("ts"), gap_s * 1000000, time_block("ts", block_s),
        "sighting", {c: F.col(c) for c in STATE_FIELDS})
    return filled.select(
        *[c for c in filled.columns if c != "position"],
        F.col("position.lat").alias("lat"), F.col("position.lon").alias("lon"))


def positioned(aircraft: DataFrame) -> DataFrame:
    """Aircraft that can be drawn: a non-zero position and an id."""
    return aircraft.filter((F.col("lat") != 0) & (F.col("lon") != 0) & marker_id().isNotNull())


def marker_id() -> Column:
    return F.coalesce(F.nullif(F.col("hex"), F.lit("")), F.nullif(strip_ws("flight"), F.lit("")))


def aircraft_count(aircraft: DataFrame) -> DataFrame:
    return positioned(aircraft).agg(F.count_distinct(marker_id()).alias("aircraft"))


# --- texts ------------------------------------------------------------------------------

def _callsign() -> Column:
    return F.nullif(strip_ws("flight"), F.lit(""))


def _hundreds() -> Column:
    """Altitude to the nearest 100 ft, halves up; NULL when missing or 0."""
    alt = F.nullif(F.col("altitude"), F.lit(0))
    return F.nullif((F.floor(alt / 100.0 + 0.5) * 100).cast("bigint"), F.lit(0).cast("bigint"))


def _number(c: Column) -> Column:
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def aircraft_labels(aircraft: DataFrame) -> DataFrame:
    alt = _hundreds()
    level = F.when(alt >= 10000, F.concat(F.lit("FL"), (alt / 100).cast("bigint").cast("string"))).otherwise(
        F.concat(alt.cast("string"), F.lit("ft")))
    name = F.coalesce(_callsign(), F.nullif(F.col("hex"), F.lit("")), F.lit("???"))
    return aircraft.withColumn("label", F.concat_ws(" ", name, level))


def aircraft_detail(aircraft: DataFrame) -> DataFrame:
    speed = F.nullif(F.col("speed"), F.lit(0.0))
    vr = F.col("vert_rate")
    heading = F.floor(F.col("track") + 0.5).cast("bigint").cast("string")
    return aircraft.withColumn("detail", F.concat_ws(
        "<br>",
        F.concat(F.lit("<b>"), F.coalesce(_callsign(), "hex"), F.lit("</b>")),
        F.concat(F.lit("ICAO: "), F.coalesce("hex", F.lit("?"))),
        F.concat(F.lit("Alt: "), F.coalesce(_hundreds().cast("string"), F.lit("?"))),
        F.concat(F.lit("Spd: "), F.coalesce(F.concat(_number(speed), F.lit(" kt")), F.lit("n/a"))),
        F.concat(F.lit("Hdg: "), F.coalesce(F.concat(heading, F.lit("°")), F.lit("n/a"))),
        F.concat(F.lit("VS: "), F.when(vr > 0, "+").otherwise(""), vr.cast("string"), F.lit(" fpm")),
        F.concat(F.lit("Squawk: "), F.nullif(F.col("squawk"), F.lit(""))),
    ))


# --- callsigns -----------------------------------------------------------------------------

def callsigns(text: str | Column) -> Column:
    """Callsigns in a transcript, normalised and duplicate-free: airlines, codes, N-numbers."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    spoken = rf"(?i)\b(?:{'|'.join(dims.AIRLINES)})\s+\d{{1,4}}\b"
    coded = r"\b[A-Z]{3}\s*\d{1,4}\b"
    tail = r"(?i)\b(N\d{1,5}[A-Z]{0,2})\b"
    codes = F.create_map(*[F.lit(x) for kv in dims.AIRLINES.items() for x in kv])

    def named(m: Column) -> Column:
        who = F.regexp_replace(m, r"\s+\d+$", "")
        code = F.coalesce(F.try_element_at(codes, F.lower(who)), F.upper(who))
        return F.concat(code, F.regexp_extract(m, r"\d+$", 0))

    # each family is searched once; the parts are read from the short matches
    spoken_names = F.transform(rx_all(t, spoken, 0), named)
    plain = F.transform(rx_all(t, coded, 0), lambda m: F.regexp_replace(m, r"\s+", ""))
    own = F.transform(rx_all(t, tail, 1), lambda n: F.upper(n))
    return F.array_distinct(F.concat(spoken_names, plain, own))


def extract_callsigns(t: DataFrame, text: str = "text") -> DataFrame:
    return t.withColumn("callsigns", callsigns(text))


def spoken_callsigns(t: DataFrame, *keep: str) -> DataFrame:
    """One row ``(keep..., pos, callsign)`` per callsign of each transcript."""
    rows = t.select(*keep, F.posexplode_outer("callsigns").alias("pos", "callsign"))
    # a plain explode would make Spark extract the callsigns a second time to filter on their number
    return rows.filter(F.col("callsign").isNotNull())


_GRAM = 6  # characters of the pieces by which longer names meet


def _pieces(name: str, low: int, high: Column | int) -> Column:
    """The distinct substrings of ``low`` to ``high`` characters."""
    c, n = F.col(name), F.length(name)
    top = F.least(n, F.lit(high) if isinstance(high, int) else high)
    return F.when(top >= low, F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(low), top), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(c, i, k))))))


def _inside(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs ``(short, long)`` of distinct names of which the first is contained in the second.

    A name of fewer characters than a piece has is itself a substring key of the other. A longer one has to have all its pieces in
    some longer name, and meets the names that share its rarest piece; what remains is compared. So a name makes rows in
    proportion to its length, garbled ones of any length included, and common pieces bring nobody together.
    """
    brief = short.filter(F.length("short") < _GRAM).join(
        long.select("long", F.explode(_pieces("long", 1, _GRAM - 1)).alias("short")), "short").select("short", "long")
    held = long.select("long", F.explode(_pieces("long", _GRAM, _GRAM)).alias("piece"))
    common = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    wanted = short.filter(F.length("short") >= _GRAM).withColumn("pieces", _pieces("short", _GRAM, _GRAM)).select(
        "short", F.size("pieces").alias("all"), F.explode("pieces").alias("piece"))
    rarest = wanted.join(common, "piece").groupBy("short", "all").agg(
        F.min_by("piece", F.struct("n", "piece")).alias("piece"), F.count(F.lit(1)).alias("found")).filter(F.col("found") == F.col("all"))
    met = rarest.select("short", "piece").join(held, "piece").filter(F.col("long").contains(F.col("short")))
    return brief.union(met.select("short", "long"))


def flight_key() -> Column:
    """The flight as compared with callsigns: trimmed, upper case, NULL when empty."""
    return F.nullif(F.upper(strip_ws("flight")), F.lit(""))


def matching_names(calls: DataFrame, flights: DataFrame) -> DataFrame:
    """Distinct ``(callsign, flight_key)`` pairs where one text contains the other; see :func:`_inside`.

    The distinct names of both sides are written once, as both directions read them several times.
    """
    c = stored(calls.select("callsign").filter(F.length("callsign") > 0).distinct(), "callsigns")
    f = stored(flights.select("flight_key").filter(F.col("flight_key").isNotNull()).distinct(), "flights")
    in_flight = _inside(c.withColumnRenamed("callsign", "short"), f.withColumnRenamed("flight_key", "long"))
    in_call = _inside(f.withColumnRenamed("flight_key", "short"), c.withColumnRenamed("callsign", "long"))
    return in_flight.select(F.col("short").alias("callsign"), F.col("long").alias("flight_key")).union(
        in_call.select(F.col("long").alias("callsign"), F.col("short").alias("flight_key"))).distinct()


def match_flights(calls: DataFrame, flights: DataFrame, id_col: str = "transcript_id") -> DataFrame:
    """Flights a transcript names: one row per transcript and flight row.

    ``calls`` holds ``(id, pos, callsign)``; the first callsign in list order
    that matches is reported.
    """
    keyed = flights.withColumn("flight_key", flight_key())
    pairs = matching_names(calls, keyed)
    hits = calls.join(pairs, "callsign").join(keyed, "flight_key")
    return hits.groupBy(id_col, *flights.columns).agg(F.min_by("callsign", "pos").alias("matched_callsign"))


def _in_force(track: DataFrame, age: int, block_s: int) -> DataFrame:
    """States with a flight name, and the microseconds ``us`` to ``until`` in which each is the newest of its aircraft and not older than ``age``."""
    states = track.withColumns({"flight_key": flight_key(), "_blk": time_block("ts", max(block_s, age // 1000000))}).select(
        "hex", "_blk", "ts", "seq", F.struct("flight_key", *_STATE_COLS).alias("s"))
    # a block is at least as long as a state stays valid, so only the block after it matters: its first moment closes the block
    after = states.groupBy("hex", "_blk").agg(F.min("ts").alias("ts")).select(
        "hex", F.col("_blk") - 1, "ts", F.lit(None).cast("bigint"), F.lit(None).cast(states.schema["s"].dataType))
    w = Window.partitionBy("hex", "_blk").orderBy("ts", "seq")
    us = micros("ts")
    held = states.union(after).withColumn("until", F.least(F.coalesce(F.lead(us).over(w) - 1, us + age), us + age))
    return held.filter(F.col("s.flight_key").isNotNull() & (F.col("until") >= us)).select("hex", "ts", us.alias("us"), "until", "s.*")


_STATE_COLS = ["flight", "altitude", "speed", "track", "lat", "lon", "vert_rate", "squawk"]
_BINS = 1024  # that a state may touch
_SHARES = 16  # among which the transcripts of one bin may be dealt
_PLACE = "_place"  # bin and share in one number


class _AsOf:
    """The inputs of the as-of join, and how its rows are dealt to tasks.

    A task gets the transcripts and the states of some time bins. Where transcripts are dense, those of a bin are dealt over shares by
    their id, and the bin's states go to each share. So all matches of a transcript at one moment come out in one task.
    """

    def __init__(self, transcripts: DataFrame, track: DataFrame, max_age_s: int, block_s: int):
        age = max_age_s * 1000000
        # rows that are dealt by place are joined and grouped by more columns than that without another shuffle
        self.own = session_with(transcripts.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false"})
        self.states = stored(_in_force(track, age, block_s), "states", self.own)
        self.heard = stored(transcripts.select("transcript_id", "ts", "callsigns").filter(F.size("callsigns") > 0).distinct(), "heard", self.own)
        pairs = matching_names(spoken_callsigns(self.heard, "transcript_id"), self.states)
        call, flight = F.concat(F.lit("c:"), "callsign"), F.concat(F.lit("f:"), "flight_key")
        self.names = stored(pairs.withColumn("meet", F.when(F.col("flight_key").contains(F.col("callsign")), call).otherwise(flight)), "names")
        n, total = self.states.agg(F.count(F.lit(1)), F.sum(F.col("until") - F.col("us"))).first()
        self.width = max((total or 0) // max(2 * n, 1), age // _BINS, 1)
        # only the few bins with far more than a task's and a bin's part of the transcripts are dealt over shares
        tasks = int(self.own.conf.get("spark.sql.shuffle.partitions"))
        bins = stored(self.heard.groupBy(self.bin_of(micros("ts")).alias("bin")).agg(F.count(F.lit(1)).alias("n")).filter("bin IS NOT NULL"), "bins", self.own)
        known, heard = bins.agg(F.count(F.lit(1)), F.sum("n")).first()
        most = max(4 * (heard or 0) // tasks, 2 * (heard or 0) // max(known, 1), 1)
        self.shares = {r["bin"]: min(-(-r["n"] // most), _SHARES) for r in bins.filter(F.col("n") > most).collect()}

    def bin_of(self, us: Column) -> Column:
        return F.floor(us / F.lit(self.width)).cast("bigint")

    def share_count(self) -> Column:
        known = [F.lit(x).cast("bigint") for kv in self.shares.items() for x in kv]
        return F.coalesce(F.try_element_at(F.create_map(*known), F.col("_bin")), F.lit(1)) if known else F.lit(1)

    def placed(self, transcripts: DataFrame) -> DataFrame:
        """Transcripts where the join has those of their id and moment."""
        rows = transcripts.withColumn("_bin", self.bin_of(micros("ts")))
        share = F.pmod(F.xxhash64("transcript_id"), self.share_count())
        return rows.withColumn(_PLACE, F.col("_bin") * _SHARES + share).drop("_bin").repartition(_PLACE)

    def matches(self, heard: DataFrame) -> DataFrame:
        """Rows of :func:`aircraft_as_of`, and their place."""
        by_call = self.names.groupBy("callsign").agg(F.collect_set("meet").alias("meets"))
        by_flight = self.names.groupBy("flight_key").agg(F.collect_set("meet").alias("meets"))
        calls = heard.select("transcript_id", "ts", "callsigns", F.posexplode_outer("callsigns").alias("pos", "callsign"))
        asked = self.placed(calls.join(by_call, "callsign").select(
            "meets", "transcript_id", "ts", "callsign", F.slice("callsigns", F.lit(1), F.col("pos")).alias("before")))
        # the names that a row meets are put in rows of their own behind the shuffle
        asked = asked.select(_PLACE, F.explode("meets").alias("meet"), micros("ts").alias("now"), "transcript_id", F.col("ts").alias("heard_at"), "callsign", "before")
        valid = self.states.join(by_flight, "flight_key").withColumn(
            "_bin", F.explode(F.sequence(self.bin_of(F.col("us")), self.bin_of(F.col("until")))))
        place = F.col("_bin") * _SHARES
        if self.shares:
            place = F.explode(F.sequence(place, place + self.share_count() - 1))
        valid = valid.withColumn(_PLACE, place).drop("_bin").repartition(_PLACE).withColumn("meet", F.explode("meets")).drop("meets")
        hits = asked.join(valid, ["meet", _PLACE]).filter(F.col("now").between(F.col("us"), F.col("until")))
        # the first callsign that matches counts
        key = F.col("flight_key")
        earlier = F.coalesce(F.exists("before", lambda c: (F.length(c) > 0) & (key.contains(c) | c.contains(key))), F.lit(False))
        return hits.filter(~earlier).select(
            "transcript_id", F.col("heard_at").alias("ts"), "hex", *_STATE_COLS, F.col("ts").alias("seen"), F.col("callsign").alias("matched_callsign"), _PLACE)

    def parted(self, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Transcripts whose id has one moment in ``rows``, and the others, if there are any."""
        moments = rows.select(F.col("transcript_id").alias("id"), "ts").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        again = stored(moments.filter("n > 1").select("id"), "again", self.own)
        if again.isEmpty():
            return self.heard, None
        same = F.col("transcript_id").eqNullSafe(F.col("id"))
        return self.heard.join(again, same, "left_anti"), self.heard.join(again, same, "left_semi")


def aircraft_as_of(
    transcripts: DataFrame, track: DataFrame, max_age_s: int = dims.AIRCRAFT_TTL_S, block_s: int = 3600,
) -> DataFrame:
    """State, at the moment of a transcript, of each aircraft the transcript names.

    ``transcripts`` has ``(transcript_id, ts, callsigns)``, ``track`` the full
    state after every update. One ordered pass per aircraft finds how long each
    state is in force. Transcripts and states are shuffled by time bins; there, of a
    callsign and a flight, the longer name makes a row for each name it contains,
    and both meet at the shorter one, so matches come out of one join and are not
    shuffled. Bins are half as wide as the mean time a state is in force: states
    make about three rows each, and few updates of an aircraft share a bin.
    """
    as_of = _AsOf(transcripts, track, max_age_s, block_s)
    return as_of.matches(as_of.heard).drop(_PLACE)


def matched_flights(as_of: DataFrame) -> DataFrame:
    """Matches of :func:`aircraft_as_of` as :func:`match_flights` gives them: one row per transcript and flight in the air at its moment."""
    return as_of.select("transcript_id", "hex", "flight", "matched_callsign")


def match_events(matches: DataFrame, id_col: str = "transcript_id", *place: str) -> DataFrame:
    """One row per transcript with its matched flights, ordered by aircraft; ``place`` are columns in which a transcript's rows agree."""
    cols = [c for c in matches.columns if c not in (id_col, *place)]
    flights = F.sort_array(F.collect_list(F.struct("hex", *[c for c in cols if c != "hex"])))
    return matches.groupBy(id_col, *place).agg(flights.alias("matches"))


def as_of_events(transcripts: DataFrame, track: DataFrame, max_age_s: int = dims.AIRCRAFT_TTL_S, block_s: int = 3600) -> DataFrame:
    """``match_events`` of the ``matched_flights`` of :func:`aircraft_as_of`, gathered where the join finds them: only matches of ids that
    come with several moments are shuffled."""
    as_of = _AsOf(transcripts, track, max_age_s, block_s)
    alone, rest = as_of.parted(as_of.heard)
    out = match_events(_flights(as_of.matches(alone)), "transcript_id", _PLACE).drop(_PLACE)
    return out if rest is None else out.union(match_events(matched_flights(as_of.matches(rest))))


def transcripts_with_events(transcripts: DataFrame, track: DataFrame, max_age_s: int = dims.AIRCRAFT_TTL_S, block_s: int = 3600) -> DataFrame:
    """The transcripts that name aircraft in the air, with their ``matches`` as :func:`as_of_events` has them; these stay where they are
    found, in plans of this table's session."""
    as_of = _AsOf(transcripts, track, max_age_s, block_s)
    alone, rest = as_of.parted(transcripts)
    events = match_events(_flights(as_of.matches(alone)), "transcript_id", _PLACE)
    out = events.join(as_of.placed(transcripts), ["transcript_id", _PLACE]).select(*transcripts.columns, "matches")
    if rest is None:
        return out
    return out.union(transcripts.join(match_events(matched_flights(as_of.matches(rest))), "transcript_id").select(*transcripts.columns, "matches"))


def _flights(matches: DataFrame) -> DataFrame:
    return matches.select("transcript_id", "hex", "flight", "matched_callsign", _PLACE)


def vanished(prev: DataFrame, cur: DataFrame) -> DataFrame:
    return prev.join(cur.select("hex"), "hex", "left_anti")


def highlightable(matches: DataFrame, cur: DataFrame) -> DataFrame:
    """Matches whose aircraft is in the table ``cur``.

    The ids are written first: so Spark knows their size, and only ids that are too many to broadcast cost a shuffle of the matches.
    """
    return matches.join(stored(cur.select("hex").distinct(), "live"), "hex", "left_semi")


def active_highlights(matches: DataFrame, as_of: Column, seconds: int = dims.HIGHLIGHT_S, ts: str = "ts") -> DataFrame:
    """Matches still lit at a moment."""
    age = micros(as_of) - micros(ts)
    return matches.filter((age >= 0) & (age <= seconds * 1000000))
