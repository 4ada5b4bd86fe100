"""Weather texts, quality filter and banners on written-out rows."""

import pytest
from pyspark.sql import functions as F

from aetherlog.functions import text as X
from aetherlog.operators import transcripts as T
from aetherlog.sources import readers

# Sentences of our own in the shape of broadcast transcripts.
CLEAR = (
    "weather service report friday temperature 45 degrees clear winds north at 8 miles per hour visibility 10 miles "
    "tonight clear and calm lows near 36 tomorrow some clouds saturday some clouds sunday showers possible"
)
STORM = (
    "the service has issued a winter storm warning for the cascades near seattle winds southwest 20 to 30 miles per hour "
    "visibility one quarter mile in snow temperature 34 degrees winds southwest at 12 miles per hour"
)
MARINE = (
    "marine report puget sound small craft advisory south winds 20 to 30 knots visibility 3 miles "
    "strait of juan de fuca west winds 15 knots coastal waters gale warning in effect"
)


@pytest.fixture(scope="module")
def reports(spark):
    rows = [("clear", CLEAR), ("storm", STORM), ("marine", MARINE), ("short", "temperature 55 degrees and so on"),
            ("none", "nothing to report here"), ("blank", " \t "), ("null", None),
            ("knts", "winds north at 5 to 10 knts"), ("calm", "Winds light and variable"),
            ("word", "visibility seven miles"), ("odd", "visibility many miles")]
    df = spark.createDataFrame([(k, t, "2026-01-01") for k, t in rows], "id string, text string, ts string")
    return {r["id"]: r for r in T.weather_reports(df).withColumn("banner", T.alert_banner()).collect()}


def test_clear(reports):
    r = reports["clear"]
    assert (r.temperature.value, r.wind.speed, r.wind.direction, r.wind.unit, r.visibility.value) == (45, 8, "north", "mph", 10.0)
    assert r.confidence == "full" and r.alerts == [] and r.marine == []
    assert [f.period for f in r.forecast] == ["Tonight", "Tomorrow", "Saturday", "Sunday", "Friday"]
    assert r.forecast[0].forecast == "tonight clear and calm lows near 36"


def test_storm_takes_first_wind_and_first_listed_area(reports):
    r = reports["storm"]
    assert (r.wind.speed, r.visibility.value, r.temperature.value) == (30, 0.25, 34)
    assert [(a.type, a.name, a.area) for a in r.alerts] == [("warning", "Winter Storm Warning", "Seattle")]
    assert r.banner == "Winter Storm Warning — Seattle. "


def test_marine(reports):
    r = reports["marine"]
    assert r.temperature is None and r.wind.unit == "knots" and r.visibility.value == 3.0 and r.confidence == "partial"
    assert [a.name for a in r.alerts] == ["Gale Warning", "Small Craft Advisory"]
    assert [m.zone for m in r.marine] == ["Puget Sound", "Strait Of Juan De Fuca", "Coastal Waters"]
    assert r.marine[1].forecast == "strait of juan de fuca west winds 15 knots"


def test_short_cases(reports):
    assert reports["short"].confidence == "partial"
    assert reports["none"].confidence == "low"
    for k in ("blank", "null"):
        r = reports[k]
        assert r.raw_transcript == "" and r.confidence == "low" and r.alerts == [] and r.temperature is None
        assert r.banner == "Weather alert detected"
    assert (reports["knts"].wind.speed, reports["knts"].wind.unit) == (10, "mph")
    assert (reports["calm"].wind.speed, reports["calm"].wind.direction) == (0, "variable")
    assert reports["word"].visibility.value == 7.0 and reports["odd"].visibility is None


def test_priority(spark):
    texts = [(CLEAR, False), (STORM, True), ("keep watching the sky", True), ("Hazardous Weather outlook", True), (None, False)]
    df = spark.createDataFrame(texts, "text string, want boolean")
    assert df.filter(T.is_priority("text") != F.col("want")).count() == 0


def test_hallucination_reasons(spark):
    cases = [
        ("a", "too_short"), (" ", "too_short"), ("Thank you.", "known_phrase"), ("I dont know what that is", "known_phrase"),
        ("(a]", "bracketed"), ("[Music]", "bracketed"), ("la-la-la-", "repetitive"), ("AB-ab-Ab-", "repetitive"),
        ("la-la-la", "short_fragment"), ("two words", "short_fragment"), ("\tok then", "short_fragment"),
        ("12345678901 abc", None), ("this is a real sentence", None), ("you know the runway is open", None),
    ]
    df = spark.createDataFrame(cases, "text string, want string")
    bad = df.withColumn("got", T.hallucination_reason("text")).filter(~F.col("got").eqNullSafe(F.col("want"))).collect()
    assert bad == []


def test_strip_removes_all_white_space(spark):
    df = spark.createDataFrame([("　\t x y  \x1f",)], "s string")
    assert df.select(X.strip_ws("s")).first()[0] == "　\t x y  \x1f".strip()


def test_post_process_routes_by_parser(spark):
    t = spark.createDataFrame(
        [("noaa-seattle", STORM), ("ksea-tower", STORM), ("nowhere", STORM)], "preset_id string, text string")
    out = T.post_process(t, readers.presets(spark), {"noaa": T.extract_temperature})
    got = {r.preset_id: r.temperature.value if r.temperature else None for r in out.collect()}
    assert got == {"noaa-seattle": 34, "ksea-tower": None, "nowhere": None}


def test_highlight_escapes(spark):
    df = spark.createDataFrame([("n12+ and N12+", ["N12+", ""])], "text string, m array<string>")
    assert df.select(T.highlight("text", "m")).first()[0] == "<b>n12+</b> and <b>N12+</b>"
