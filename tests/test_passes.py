"""Catalogue, passes, recordings, images."""

import random
import struct
import zlib

from pyspark.sql import functions as F

from aetherlog.functions import display as D
from aetherlog.operators import passes as P
from aetherlog.sources import readers

T0 = 1_772_000_000


def ts(c):
    return F.timestamp_micros(((F.col(c) + T0) * 1000000).cast("bigint"))


def greedy_tle(lines):
    lines = [s.strip() for s in lines if s.strip()]
    out, i = {}, 0
    while i < len(lines) - 2:
        name, a, b = lines[i:i + 3]
        if not (a.startswith("1 ") and b.startswith("2 ")):
            i += 1
            continue
        for sat in ("NOAA 15", "NOAA 19"):
            if sat in name and "18" not in name:
                out[sat] = (a, b)
                break
        i += 3
    return out


def test_tle_equals_reading_line_by_line(spark):
    rng = random.Random(11)
    vocab = ["NOAA 15", "NOAA 19 [+]", "NOAA 18", "1 x", "1 y", "2 x", "2 NOAA 15 y", "2 NOAA 19", "", "  "]
    files = {f"f{k}": [rng.choice(vocab) + (f" {i}" if i % 2 else "") for i in range(rng.choice([0, 2, 3, 40, 400]))] for k in range(12)}
    files["alternating"] = ["NOAA 15"] + ["1 a", "2 NOAA 19"] * 30
    rows = [(f, i, v) for f, v in files.items() for i, v in enumerate(v)]
    df = spark.createDataFrame(rows, "file string, line_no bigint, value string")
    for block in (7, 30000):
        got = {}
        for r in P.parse_tle(df, block_lines=block).collect():
            got.setdefault(r.file, {})[r.satellite] = (r.line1, r.line2)
        assert got == {f: greedy_tle(v) for f, v in files.items() if greedy_tle(v)}


def test_newest_catalogue_file(spark, tmp_path):
    import os

    for i, name in enumerate(["old", "new"]):
        f = tmp_path / f"{name}.txt"
        f.write_text(f"NOAA 15\r\n1 {name}\r\n2 {name}\r\n")
        os.utime(f, (T0 + i, T0 + i))
    got = P.parse_tle(readers.read_tle(spark, str(tmp_path))).collect()
    assert [(r.satellite, r.line1, r.line2) for r in got] == [("NOAA 15", "1 new", "2 new")]


def test_detect_passes(spark):
    el = [-5, 3, 25, 12, -1, 4, 6, -2, -3, 50, 71.26]
    df = spark.createDataFrame([("NOAA 15", 60.0 * i, float(e)) for i, e in enumerate(el)], "satellite string, s double, elevation double")
    df = df.select("satellite", ts("s").alias("ts"), "elevation")
    p = P.detect_passes(df, block_s=120)
    got = [(int(r.aos.timestamp()) - T0, r.max_elevation, r.duration_s) for r in p.orderBy("aos").collect()]
    assert got == [(60, 25.0, 120), (300, 6.0, 60), (540, 71.3, 60)]
    assert P.filter_passes(p).count() == 2
    assert P.with_frequency(p).first().frequency == "137.6200M"


def test_recordings_do_not_overlap(spark):
    rng = random.Random(5)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([0, 1, 100, 450, 899, 900, 901, 5000])
        rows.append(("S1" if i % 5 else "S2", rng.choice(["NOAA 15", "NOAA 19"]), float(t)))
    rows = list(dict.fromkeys(rows))
    want, free = [], {}
    for st, sat, at in sorted(rows, key=lambda r: (r[2], r[1])):
        if at >= free.get(st, -1):
            want.append((st, sat, at))
            free[st] = at + 900
    df = spark.createDataFrame(rows, "station string, satellite string, s double").select("station", "satellite", ts("s").alias("aos"))
    for span in (900, 86400):
        got = [(r.station, r.satellite, r.aos.timestamp() - T0) for r in P.select_recordings(df, span_s=span).collect()]
        assert sorted(got) == sorted(want)


def test_notice_times(spark):
    p = spark.createDataFrame([("NOAA 19", 1000.0)], "satellite string, s double").select("satellite", ts("s").alias("aos"))
    ticks = spark.createDataFrame([(float(s),) for s in (399, 400, 430, 989, 990, 1000, 1010, 1011)], "s double").select(ts("s").alias("tick"))
    up = {r.tick.timestamp() - T0: r.minutes_until for r in P.upcoming(p, ticks).collect()}
    assert up == {400: 10.0, 430: 9.5, 989: 0.2, 990: 0.2}
    assert {r.tick.timestamp() - T0 for r in P.starting(p, ticks).collect()} == {990, 1000, 1010}
    assert P.notices(p, ticks).first().minutes_until == 10.0


def test_first_notice_equals_all_pairs(spark):
    rng = random.Random(3)
    passes = [(rng.choice("ab"), "NOAA 19", float(rng.randrange(90000))) for _ in range(120)]
    ticks = [(rng.choice("abc"), float(rng.randrange(3000) * 30)) for _ in range(400)]
    p = spark.createDataFrame(passes, "station string, satellite string, s double").select("station", "satellite", ts("s").alias("aos"))
    k = spark.createDataFrame(ticks, "station string, s double").select("station", ts("s").alias("tick"))
    want = sorted((st, at, min(t for s2, t in ticks if s2 == st and 0 < at - t <= 600)) for st, _, at in passes
                  if any(s2 == st and 0 < at - t <= 600 for s2, t in ticks))
    for block in (300, 3600):
        got = P.notices(p, k, station=["station"], block_s=block).collect()
        assert sorted((r.station, r.aos.timestamp() - T0, r.tick.timestamp() - T0) for r in got) == want
    grid = P.tick_grid(k.union(k), ["station"])
    assert grid.count() == len(set(ticks))


def test_passes_do_not_depend_on_the_order_of_rows(spark):
    rows = [(0.0, 1, 5.0), (0.0, 2, -5.0), (60.0, 3, -5.0), (60.0, 4, 7.0), (120.0, 5, 9.0), (120.0, 6, None)]
    want = None
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "s double, seq int, elevation double").select(F.lit("x").alias("satellite"), ts("s").alias("ts"), "seq", "elevation")
        got = sorted((int(r.aos.timestamp()) - T0, int(r.los.timestamp()) - T0, r.max_elevation) for r in P.detect_passes(df, order=["seq"]).collect())
        want = want or got
        assert got == want == [(0, 0, 5.0), (60, 120, 9.0)]


def test_equal_images_stay(spark):
    images = spark.createDataFrame([("a", "2026-03-01 10:05:00")] * 3 + [("b", None)], "satellite string, t string").select("satellite", F.to_timestamp("t").alias("pass_ts"))
    p = spark.createDataFrame([("a", 60.0)], "satellite string, max_elevation double").withColumns({
        "aos": F.lit("2026-03-01 10:04:00").cast("timestamp"), "los": F.lit("2026-03-01 10:14:00").cast("timestamp")})
    out = P.images_with_pass(images, p, location="47N, 122W").collect()
    assert sorted((r.satellite, r.max_elevation, r.location) for r in out) == [("a", 60.0, "47N, 122W")] * 3 + [("b", 0.0, "47N, 122W")]


def test_images(spark, tmp_path):
    def png(name):
        raw = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", zlib.crc32(b""))
        (tmp_path / name).write_bytes(raw)

    for n in ("NOAA-19_2026-03-01T1000Z.png", "NOAA-15_2026-03-02T1000Z.png", "plain.png", "notes.txt"):
        png(n)
    listing = readers.read_images(spark, str(tmp_path))
    # only the path is asked of the scan
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    got = {r.filename: r for r in P.parse_image_name(listing).collect()}
    assert len(got) == 3
    r = got["NOAA-19_2026-03-01T1000Z.png"]
    assert (r.satellite, r.pass_time, r.url) == ("NOAA 19", "2026-03-01T1000Z", "/static/images/apt/NOAA-19_2026-03-01T1000Z.png")
    assert r.pass_ts.isoformat() == "2026-03-01T10:00:00"
    assert (got["plain.png"].satellite, got["plain.png"].pass_time, got["plain.png"].pass_ts) == ("plain", "", None)
    named = P.parse_image_name(listing).filter("pass_time <> ''")
    assert P.latest_image(named).first().satellite == "NOAA 19"
    assert P.latest_image(named, "time").first().satellite == "NOAA 15"
    passes = spark.createDataFrame([("NOAA 19", "2026-03-01 10:01:30", "2026-03-01 10:14:00", 55.0)], "satellite string, a string, l string, max_elevation double")
    passes = passes.select("satellite", F.to_timestamp("a").alias("aos"), F.to_timestamp("l").alias("los"), "max_elevation")
    with_pass = {r.satellite: r.max_elevation for r in P.images_with_pass(named, passes).collect()}
    assert with_pass == {"NOAA 19": 55.0, "NOAA 15": 0.0}


def test_display(spark):
    df = spark.range(1).select(
        D.countdown(F.lit("2026-01-01 01:02:03").cast("timestamp"), F.lit("2026-01-01").cast("timestamp")).alias("a"),
        D.countdown(F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-01").cast("timestamp")).alias("b"),
        D.countdown(F.lit(None).cast("timestamp"), F.lit("2026-01-01").cast("timestamp")).alias("c"),
        D.countdown(F.lit("2026-01-01 00:00:09").cast("timestamp"), F.lit("2026-01-01").cast("timestamp")).alias("d"),
        D.relative_time(F.lit(None).cast("timestamp"), F.lit("2026-01-01").cast("timestamp")).alias("e"),
        D.meter_band(D.meter_pct(F.lit(7000.0))).alias("f"), D.rtf_band(F.lit(0.0)).alias("g"), D.elevation_band(F.lit(59.9)).alias("h"))
    assert tuple(df.first()) == ("1h 02:03", "NOW", "--:--:--", "00:09", "never", "high", None, "mid")
