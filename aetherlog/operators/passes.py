"""Satellite catalogue, passes, recordings and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aetherlog import dims
from aetherlog.functions.display import micros, minutes_until
from aetherlog.functions.text import strip_ws
from aetherlog.plans.bins import point_in_interval
from aetherlog.plans.blocked import index_block, numbered, running, time_block
from aetherlog.plans.chain import follow_chain

SECOND = 1000000


# --- catalogue --------------------------------------------------------------------------

def parse_tle(
    lines: DataFrame, tracked: list[str] = list(dims.SATELLITES), key: list[str] = ["file"], block_lines: int = 30000,
) -> DataFrame:
    """Element sets of tracked satellites from ``(file, line_no, value)`` lines.

    A record is a name line, a ``1 `` line and a ``2 `` line; reading goes on
    after a record, or one line further where there is none. Two records can
    only share a line when the second one's name is the first one's ``2 ``
    line, so in a run of records two lines apart every other one is real.
    """
    full = lines.withColumn("value", strip_ws("value")).filter(F.length("value") > 0)
    rows = numbered(full, key, ["line_no"], index_block("line_no", block_lines), "at")
    # two lines are borrowed from the next block
    at, own = F.col("at"), index_block("at", block_lines)
    reach = F.array_distinct(F.array(own, index_block(at - 2, block_lines)))
    spread = rows.withColumns({"_own": own, "_blk": F.explode(reach)}).filter(F.col("_blk") >= 0)
    w = Window.partitionBy(*key, "_blk").orderBy("at")
    ahead = spread.withColumns({"line1": F.lead("value", 1).over(w), "line2": F.lead("value", 2).over(w)})
    record = F.col("line1").startswith("1 ") & F.col("line2").startswith("2 ")
    flagged = ahead.filter(F.col("_own") == F.col("_blk")).withColumns({
        "_rec": F.coalesce(record, F.lit(False)), "_odd": at % 2})
    # the line of the same parity where the last run of records ended
    ended = ("last", F.when(~F.col("_rec"), at))
    runs = running(flagged, [*key, "_odd"], ["at"], index_block("at", block_lines), _end=ended)
    place = (at - F.coalesce("_end", F.col("_odd") - 2)) / 2
    real = runs.filter(F.col("_rec") & (place % 2 == 1))
    name = F.col("value")
    hits = [F.when(name.contains(s) & ~name.contains(dims.EXCLUDED_NAME_PART), F.lit(s)) for s in tracked]
    found = real.withColumn("satellite", F.coalesce(*hits)).filter(F.col("satellite").isNotNull())
    newest = found.groupBy(*key, "satellite").agg(F.max_by(F.struct("line1", "line2"), "at").alias("e"))
    return newest.select(*key, "satellite", "e.line1", "e.line2")


def stale(df: DataFrame, as_of: Column, ts: str = "fetched_at", hours: int = dims.STALE_HOURS) -> DataFrame:
    """Catalogues never fetched or older than the limit."""
    age = micros(as_of) - micros(ts)
    return df.filter(F.col(ts).isNull() | (age > hours * 3600 * SECOND))


# --- passes --------------------------------------------------------------------------------

def detect_passes(
    samples: DataFrame, key: list[str] = ["satellite"], horizon: float = 0.0, block_s: int = 3600, order: list[str] = [],
) -> DataFrame:
    """Each maximal run of samples above the horizon is a pass.

    Samples of one instant are taken in the order of the columns in ``order``, then by elevation, so the result
    does not depend on the order of the rows.

    Runs are told apart by the sample that ended the one before and are summed up
    with partial aggregation, so a long pass or a busy satellite is no hot task.
    """
    up = F.coalesce(F.col("elevation") > horizon, F.lit(False))
    sequence = ["ts", *order, "_height"]
    rows = samples.select(*key, "elevation", "ts", *order, F.coalesce("elevation", F.lit(float("-inf"))).alias("_height"))
    # all samples of a pass share the newest sample below the horizon
    runs = running(rows, key, sequence, time_block("ts", block_s), _down=("last", F.when(~up, F.struct(*sequence))))
    per = runs.filter(up).groupBy(*key, "_down").agg(
        F.min("ts").alias("_aos"), F.max("ts").alias("los"), F.max("elevation").alias("_max"))
    return per.select(
        *key, F.col("_aos").alias("aos"), "los", F.round("_max", 1).alias("max_elevation"),
        F.round((micros("los") - micros("_aos")) / SECOND).cast("bigint").alias("duration_s"))


def filter_passes(p: DataFrame, min_deg: float = dims.MIN_ELEVATION_DEG) -> DataFrame:
    return p.filter(F.col("max_elevation") >= min_deg)


def passes_within(p: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    at = micros("aos")
    now = micros(as_of)
    return p.filter((at >= now) & (at <= now + hours * 3600 * SECOND))


def with_frequency(p: DataFrame) -> DataFrame:
    hits = [F.when(F.col("satellite") == s, F.lit(f)) for s, f in dims.SATELLITES.items()]
    return p.withColumn("frequency", F.coalesce(*hits, F.lit("")))


def sort_passes(p: DataFrame) -> DataFrame:
    return p.orderBy("aos", "satellite")


def next_passes(p: DataFrame, n: int = 5, ties: tuple[str, ...] = ()) -> DataFrame:
    return p.orderBy("aos", "satellite", *ties).limit(n)


def tick_grid(ticks: DataFrame, key: list[str] = [], every_s: int = dims.PASS_CHECK_S, tick: str = "tick") -> DataFrame:
    """Ticks on the grid of the pass check: one per key and slot, so a notice time holds a fixed number of them."""
    slot = F.floor(micros(tick) / (every_s * SECOND)).cast("bigint")
    return ticks.select(*key, slot.alias("slot")).distinct().select(
        *key, "slot", F.timestamp_micros(F.col("slot") * every_s * SECOND).alias("tick"))


def _pass_near_tick(passes: DataFrame, ticks: DataFrame, key: list[str], before_s: int, after_s: int, open_end: bool) -> DataFrame:
    """Ticks at most ``before_s`` ahead of and ``after_s`` past the start of a pass of the same ``key``."""
    at, tick = micros("aos"), micros("tick")
    test = (at - tick <= before_s * SECOND) & ((at - tick > 0) if open_end else (at - tick >= -after_s * SECOND))
    return point_in_interval(
        ticks, passes, key, tick, at - before_s * SECOND, at + after_s * SECOND,
        max(before_s + after_s, 1) * SECOND, test)


def upcoming(passes: DataFrame, ticks: DataFrame, notice_s: int = dims.NOTICE_S, station: list[str] = []) -> DataFrame:
    """Ticks inside the notice time before a pass; ``station`` names what ticks and passes have in common.

    Rows out are ticks per notice time: with ticks on the grid at most 20 per pass.
    """
    hits = _pass_near_tick(passes, ticks, station, notice_s, 0, True)
    return hits.withColumn("minutes_until", minutes_until("aos", "tick"))


def notices(
    passes: DataFrame, ticks: DataFrame, notice_s: int = dims.NOTICE_S, station: list[str] = [], block_s: int = 3600,
) -> DataFrame:
    """One notice per pass, at the first tick inside the notice time.

    One ordered walk over ticks and passes, newest first, hands each pass the tick that follows
    the beginning of its notice time; no pair of a pass with its other ticks is built.
    """
    key = station or ["_all"]
    p, c = (df if station else df.withColumn("_all", F.lit(0)) for df in (passes, ticks))
    none = F.lit(None)
    due = micros("aos") - notice_s * SECOND
    left = c.select(*key, (-micros("tick")).alias("_t"), F.lit(0).alias("_side"), F.struct("tick").alias("_tick"))
    row = F.struct(*[x for x in p.columns if x not in key])
    right = p.select(*key, (-due).alias("_t"), F.lit(1).alias("_side"), row.alias("_pass"))
    both = left.withColumn("_pass", none.cast(right.schema["_pass"].dataType)).unionByName(
        right.withColumn("_tick", none.cast(left.schema["_tick"].dataType)))
    walked = running(both, key, ["_t", "_side"], index_block("_t", block_s * SECOND), _next=("last", F.col("_tick")))
    found = walked.filter(F.col("_side") == 1).select(*station, "_pass.*", F.col("_next.tick").alias("tick"))
    return found.filter(micros("aos") - micros("tick") > 0).withColumn("minutes_until", minutes_until("aos", "tick"))


def starting(passes: DataFrame, ticks: DataFrame, tolerance_s: int = dims.START_TOLERANCE_S, station: list[str] = []) -> DataFrame:
    return _pass_near_tick(passes, ticks, station, tolerance_s, tolerance_s, False)


def select_recordings(
    passes: DataFrame, busy_s: int = dims.RECORD_S, key: list[str] = ["station"], span_s: int | None = None,
    rows_per_span: int = 2000,
) -> DataFrame:
    """Passes a station can record, earliest first, none while another is being recorded.

    A task works on the passes that begin within ``span_s`` at one station. Unless given, the span is chosen so that the
    busiest station has about ``rows_per_span`` of them in it: a day at most, a recording at least.
    """
    one = passes.withColumn("_at", micros("aos")).groupBy(*key, "_at").agg(
        F.min_by(F.struct(*[c for c in passes.columns if c not in key]), "satellite").alias("p"))
    if span_s is None:
        rate = passes.groupBy(*key).agg(
            (F.count(F.lit(1)) / F.greatest(F.lit(86400.0), (F.max(micros("aos")) - F.min(micros("aos"))) / SECOND)).alias("r"))
        most = rate.agg(F.max("r")).first()[0] or 0.0
        span_s = 86400 if most * 86400 <= rows_per_span else int(rows_per_span / most)
    jumps = one.select(*key, "_at", (F.col("_at") + busy_s * SECOND).alias("_free"))
    chosen = follow_chain(jumps, key, "_at", "_free", busy_s * SECOND, max(span_s, busy_s) * SECOND)
    return one.join(chosen.select(*key, "_at"), [*key, "_at"]).select(*key, "p.*")


# --- images ---------------------------------------------------------------------------------

def parse_image_name(images: DataFrame, path: str = "path") -> DataFrame:
    """Satellite, pass time and public URL from ``NAME-NO_yyyy-MM-ddTHHmmZ.png``."""
    filename = F.substring_index(F.col(path), "/", -1)
    stem = F.replace(filename, F.lit(".png"), F.lit(""))
    cut = F.instr(stem, "_")
    time_text = F.when(cut > 0, F.substr(stem, cut + 1)).otherwise("")
    return images.withColumns({
        "filename": filename,
        "satellite": F.translate(F.substring_index(stem, "_", 1), "-", " "),
        "pass_time": time_text,
        "pass_ts": F.try_to_timestamp(time_text, F.lit("yyyy-MM-dd'T'HHmm'Z'")),
        "url": F.concat(F.lit(dims.IMAGE_URL_PREFIX), filename),
    })


def image_history(images: DataFrame, n: int = 5, by: str = "name") -> DataFrame:
    """Last ``n`` images by file name, or by pass time."""
    order = {"name": [F.desc("filename")], "time": [F.desc("pass_ts"), F.desc("filename")]}[by]
    return images.orderBy(*order).limit(n)


def latest_image(images: DataFrame, by: str = "name") -> DataFrame:
    return image_history(images, 1, by)


def images_with_pass(
    images: DataFrame, passes: DataFrame, key: list[str] = ["satellite"], location: str = "", bin_s: int = 3600,
) -> DataFrame:
    """Attach the pass an image was taken in; 0 elevation when there is none. Equal rows stay as many as they are.

    ``location`` is where the station stands.
    """
    two_min = 120 * SECOND
    p = passes.select(*key, "aos", "los", "max_elevation")
    at, lo, hi = micros("pass_ts"), micros("aos") - two_min, micros("los")
    counted = images.groupBy(*images.columns).agg(F.count(F.lit(1)).alias("_n"))
    joined = point_in_interval(counted, p, key, at, lo, hi, bin_s * SECOND, (at >= lo) & (at <= hi), "left")
    per = joined.groupBy(*counted.columns).agg(F.max_by("max_elevation", "aos").alias("max_elevation"))
    return per.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n"))).drop("_n").withColumns({
        "max_elevation": F.coalesce("max_elevation", F.lit(0.0)),
        "location": F.lit(location),
    })
