"""Transcript quality filters and weather extraction: one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aetherlog import dims
from aetherlog.schemas import ALERT
from aetherlog.functions.text import (
    SPACE, contains_any, cut_between_keywords, let, rx, snippet, strip_ws, word_count, word_to_number,
)


# --- quality filters -----------------------------------------------------------

def filter_nonempty(t: DataFrame, text: str = "text") -> DataFrame:
    return t.filter(F.length(strip_ws(text)) > 0)


def hallucination_reason(text: str | Column) -> Column:
    """Why a transcript counts as invented, or NULL; the first rule that hits decides."""
    t = strip_ws(text)
    return (
        F.when(F.length(t) <= 1, "too_short")
        .when(t.rlike(rf"^(?i:{dims.NOISE_PHRASES}){SPACE}*\.?{SPACE}*$"), "known_phrase")
        .when(t.rlike(r"^[\[(][^\n]+[\])]$"), "bracketed")
        .when(t.rlike(r"(?i)^([^\n]{1,4}[-–])\1{2,}$"), "repetitive")
        .when((F.length(t) < 15) & (word_count(t) <= 2), "short_fragment")
    )


def classify_hallucination(t: DataFrame, text: str = "text") -> DataFrame:
    return t.withColumn("reason", hallucination_reason(text))


def drop_hallucinations(t: DataFrame, text: str = "text") -> DataFrame:
    return filter_nonempty(t, text).filter(hallucination_reason(text).isNull())


# --- weather fields --------------------------------------------------------------
# All take the lower-cased text.

def temperature(low: Column) -> Column:
    hit = F.coalesce(*[rx(low, p) for p in dims.TEMPERATURE_PATTERNS])
    gated = F.when(contains_any(low, ["temperature", "currently"]), hit)
    return let(gated, lambda v: F.struct(v.try_cast("int").alias("value"), F.lit("F").alias("unit")))


def wind(low: Column) -> Column:
    # "wind(s) <number>" must occur for the second pattern, and is much quicker to look for
    second = F.when(low.rlike(r"winds?\s+\d"), rx(low, dims.WIND_DIRECTION_FIRST, 0))
    # the first pattern found anywhere decides; its parts are read from the short match
    match = F.when(low.contains("wind"), F.coalesce(rx(low, dims.WIND_NAMED_FIRST, 0), second, rx(low, dims.WIND_CALM, 0)))

    def fields(m: Column) -> Column:
        speed = F.coalesce(rx(m, r"\sto\s+(\d+)"), rx(m, r"(\d+)"), F.lit("0"))
        return F.struct(
            speed.try_cast("int").alias("speed"),
            F.coalesce(rx(m, rf"({dims.DIRECTIONS})\s"), F.lit("variable")).alias("direction"),
            F.when(m.contains("knot"), "knots").otherwise("mph").alias("unit"),
        )

    return let(match, fields)


def visibility(low: Column) -> Column:
    digits = rx(low, dims.VISIBILITY_DIGITS).try_cast("double")
    # only the first "visibility <word> mile" counts, listed or not
    word = word_to_number(rx(low, dims.VISIBILITY_WORD), dims.NUMBER_WORDS)
    value = F.coalesce(
        digits,
        F.when(low.rlike(dims.VISIBILITY_QUARTER), 0.25),
        F.when(low.rlike(dims.VISIBILITY_HALF), 0.5),
        word.cast("double"),
    )
    gated = F.when(low.contains("visibility"), value)
    return let(gated, lambda v: F.struct(v.alias("value"), F.lit("miles").alias("unit")))


def area(low: Column) -> Column:
    """First listed place found anywhere in the text; empty when none is."""
    hits = [F.when(low.contains(a), F.lit(a.title())) for a in dims.AREAS]
    return F.coalesce(*hits, F.lit(""))


def alerts(low: Column, place: Column) -> Column:
    """Listed alerts in rule order, each at most once, with the area of the text."""
    none = F.array().cast(f"array<struct<{ALERT.replace(' STRING', ':string').replace(', ', ',')}>>")

    def one(phrase: str, kind: str) -> Column:
        gap = rx(low, rf"{phrase}(\s+){kind}")
        name = F.concat(F.lit(phrase.title()), gap, F.lit(kind.title()))
        alert = F.struct(F.lit(kind).alias("type"), name.alias("name"), place.alias("area"))
        return F.when(low.contains(phrase) & gap.isNotNull(), F.array(alert)).otherwise(none)

    kinds = sorted({k for _, k in dims.ALERT_RULES})
    return F.when(contains_any(low, kinds), F.concat(*[one(p, k) for p, k in dims.ALERT_RULES])).otherwise(none)


def marine(low: Column) -> Column:
    return cut_between_keywords(low, dims.MARINE_ZONES, 5, "zone")


def forecast(low: Column) -> Column:
    return cut_between_keywords(low, dims.FORECAST_PERIODS, 3, "period")


def confidence(temp: Column, wnd: Column, vis: Column) -> Column:
    n = sum((c.isNotNull().cast("int") for c in (temp, wnd, vis)), F.lit(0))
    return F.when(n == 3, "full").when(n >= 1, "partial").otherwise("low")


def is_priority(text: str | Column) -> Column:
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    # one pattern, so that a filter pushed below other columns reads the text once
    return F.coalesce(low.rlike("|".join(dims.PRIORITY_WORDS)), F.lit(False))


# --- table-level jobs --------------------------------------------------------------

LOW, AREA = "_low", "_area"


def _lowered(t: DataFrame, text: str) -> DataFrame:
    """Lower-cased text as a column of its own, so that it is worked out once per row."""
    return t.withColumn(LOW, F.lower(F.coalesce(F.col(text), F.lit(""))))


def _add(name: str, fn: Callable[[Column], Column]):
    def job(t: DataFrame, text: str = "text") -> DataFrame:
        return _lowered(t, text).withColumn(name, fn(F.col(LOW))).drop(LOW)

    job.__name__ = f"extract_{name}"
    job.__doc__ = f"Add the ``{name}`` column."
    return job


extract_temperature = _add("temperature", temperature)
extract_wind = _add("wind", wind)
extract_visibility = _add("visibility", visibility)
extract_area = _add("area", area)


def extract_alerts(t: DataFrame, text: str = "text") -> DataFrame:
    """Add the ``alerts`` column."""
    placed = _lowered(t, text).withColumn(AREA, area(F.col(LOW)))
    return placed.withColumn("alerts", alerts(F.col(LOW), F.col(AREA))).drop(LOW, AREA)


extract_marine = _add("marine", marine)
extract_forecast = _add("forecast", forecast)


def weather_reports(t: DataFrame, text: str = "text", parsed_at: str | Column = "ts") -> DataFrame:
    """Add the whole report as columns; blank or NULL text gives an empty report."""
    low = F.col(LOW)
    blank = F.length(strip_ws(low)) == 0
    fields = _lowered(t, text).withColumn(AREA, area(low)).withColumns({
        "temperature": temperature(low), "wind": wind(low), "visibility": visibility(low),
        "alerts": alerts(low, F.col(AREA)), "marine": marine(low), "forecast": forecast(low),
    })
    at = F.col(parsed_at) if isinstance(parsed_at, str) else parsed_at
    return fields.withColumns({
        "raw_transcript": F.when(blank, "").otherwise(F.col(text)),
        "parsed_at": at,
        "confidence": confidence(F.col("temperature"), F.col("wind"), F.col("visibility")),
    }).drop(LOW, AREA)


def priority_alerts(t: DataFrame, text: str = "text") -> DataFrame:
    return t.filter(is_priority(text))


def post_process(
    t: DataFrame, presets: DataFrame, registry: dict[str, Callable[[DataFrame], DataFrame]]
) -> DataFrame:
    """Route each transcript by its preset's parser; others pass with no parsed data.

    Each registered function receives and returns a DataFrame; its extra
    columns are NULL for rows of other parsers.
    """
    routed = t.join(presets.select(F.col("id").alias("preset_id"), "parser"), "preset_id", "left")
    known = F.coalesce(F.col("parser").isin(*registry), F.lit(False))
    parts = [routed.filter(~known)]
    parts += [fn(routed.filter(F.col("parser") == name)) for name, fn in registry.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


WEATHER_PARSER = "noaa"


def heard_reports(t: DataFrame, presets: DataFrame, text: str = "text", parsed_at: str | Column = "ts") -> DataFrame:
    """Weather reports of what was heard: stripped, not invented, and only of presets with the weather parser.

    Transcripts of all other presets, unknown ones too, give no report. Adds the preset's ``freq``.
    """
    tuned = presets.filter(F.col("parser") == WEATHER_PARSER).select(F.col("id").alias("preset_id"), F.col("freq").alias("_freq"))
    clean = drop_hallucinations(t, text).withColumn(text, strip_ws(text))
    gated = clean.join(tuned, "preset_id").withColumn("freq", F.coalesce("_freq", F.lit(""))).drop("_freq")
    return weather_reports(gated, text, parsed_at)


def alert_rows(t: DataFrame, *keep: str | Column) -> DataFrame:
    """One row ``(keep..., a)`` per alert of tables with an ``alerts`` column."""
    rows = t.select(*keep, F.explode_outer("alerts").alias("a"))
    # a plain explode would make Spark work the alerts out a second time to filter on their number
    return rows.filter(F.col("a").isNotNull())


def alert_log(reports: DataFrame) -> DataFrame:
    """One row per alert of heard reports. An alert phrase holds a priority word, so every alert is of a priority report."""
    rows = alert_rows(
        reports, "stream_id", F.col("parsed_at").alias("ts"), "freq", "source",
        snippet("raw_transcript", dims.SNIPPET_CHARS).alias("snippet"))
    return rows.select("stream_id", "ts", "freq", "a.type", "a.name", "a.area", "source", "snippet")


def active_banner(alerts_col: str | Column = "alerts", raw: str | Column = "raw_transcript") -> Column:
    """The banner after a report: hidden (NULL) unless the report is a priority alert, listed alerts or not."""
    return F.when(is_priority(raw), alert_banner(alerts_col, raw))


def alert_banner(alerts_col: str | Column = "alerts", raw: str | Column = "raw_transcript") -> Column:
    """Alerts as ``name — area. ``; without alerts the raw snippet, else a fixed sentence."""
    items = F.col(alerts_col) if isinstance(alerts_col, str) else alerts_col
    raw = F.col(raw) if isinstance(raw, str) else raw
    texts = F.transform(items, lambda a: F.concat(
        a["name"], F.when(a["area"] != "", F.concat(F.lit(" — "), a["area"])).otherwise(""), F.lit(". ")))
    joined = F.nullif(F.array_join(texts, ""), F.lit(""))
    return F.coalesce(joined, F.nullif(snippet(raw, dims.SNIPPET_CHARS), F.lit("")), F.lit("Weather alert detected"))


def weather_card(reports: DataFrame) -> DataFrame:
    """Short texts of the current-conditions card."""
    vis = F.col("visibility.value")
    number = F.when(vis == F.floor(vis), vis.cast("bigint").cast("string")).otherwise(vis.cast("string"))
    return reports.withColumns({
        "temp_text": F.concat(F.col("temperature.value").cast("string"), F.lit("°"), F.col("temperature.unit")),
        "wind_text": F.when(F.col("wind.speed") == 0, "Light & variable").otherwise(
            F.concat_ws(" ", "wind.direction", F.col("wind.speed").cast("string"), "wind.unit")),
        "vis_text": F.concat(number, F.lit(" "), F.col("visibility.unit")),
    })


def recent_transcripts(
    reports: DataFrame, n: int = 3, key: str = "stream_id", order: tuple[str, ...] = ("ts",), text: str = "raw_transcript",
) -> DataFrame:
    """The newest ``n`` reports' transcripts per station; empty ones are not listed.

    Spark turns ``rank <= n`` into a per-task group limit below the shuffle,
    so a hot station sends ``n`` rows per task, not all of them.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return reports.filter(F.length(text) > 0).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def transcript_feed(t: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Feed lines ``HH:MM:SS [label] text`` in arrival order."""
    line = F.concat_ws(" ", F.date_format("ts", "HH:mm:ss"), F.concat(F.lit("["), F.col("label"), F.lit("]")), "text")
    return t.withColumn("line", line).orderBy(*order)


def highlight(text: str | Column, matches: str | Column) -> Column:
    """Mark every matched callsign in the text, case-insensitively, in list order."""
    from aetherlog.functions.text import regex_escape

    text = F.col(text) if isinstance(text, str) else text
    matches = F.col(matches) if isinstance(matches, str) else matches
    return F.aggregate(
        F.filter(matches, lambda m: F.length(m) > 0), text,
        lambda acc, m: F.regexp_replace(acc, F.concat(F.lit("(?i)("), regex_escape(m), F.lit(")")),
                                        F.lit('<b>$1</b>')))
