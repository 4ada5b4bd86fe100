"""Telemetry, aircraft state, callsigns and correlation."""

import random

import pytest
from pyspark.sql import functions as F

from aetherlog.operators import aviation as A
from aetherlog.streaming import aircraft, feeds


def line(hex_id="4ca1", callsign="", alt="", speed="", track="", lat="", lon="", vr="", squawk="", kind="MSG"):
    return ",".join([kind, "3", "1", "1", hex_id, "1", "d", "t", "d", "t", callsign, alt, speed, track, lat, lon, vr, squawk, "", ""])


def test_parse_sbs(spark):
    lines = [
        line(kind="STA"), "MSG,3,1,1,abc,1,d,t,d,t", line(hex_id=" "), line(hex_id=" a1b2c3 ", callsign="ASA412  "),
        line(alt="3000"), line(alt="abc"), line(alt="12.5"), line(lat="47.1"), line(lat="47.1", lon="bad"),
        line(lat="47.1", lon="-122.2"), line(speed="150.5", track="180", vr="-64", squawk="0123"), "MSG,3,1,1,abc,1,d,t,d,t,CS1",
    ]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(lines)], "value string, seq bigint")
    got = {r.seq: r for r in A.parse_sbs(df).collect()}
    assert set(got) == {3, 4, 5, 6, 7, 8, 9, 10, 11}
    assert (got[3].hex, got[3].flight) == ("A1B2C3", "ASA412")
    assert got[4].altitude == 3000 and got[5].altitude is None and got[6].altitude is None
    assert got[7].lat is None and got[8].lat is None and (got[9].lat, got[9].lon) == (47.1, -122.2)
    assert (got[10].speed, got[10].vert_rate, got[10].squawk) == (150.5, -64, "0123")
    assert (got[11].hex, got[11].flight, got[11].altitude) == ("ABC", "CS1", None)


UPDATES = "hex string, at double, seq bigint, flight string, altitude int, lat double, lon double"


def updates(spark, rows):
    df = spark.createDataFrame(rows, UPDATES)
    return df.select(
        "hex", F.timestamp_micros(((F.col("at") + 1.7e9) * 1000000).cast("bigint")).alias("ts"), "seq", "flight", "altitude",
        F.lit(None).cast("double").alias("speed"), F.lit(None).cast("double").alias("track"), "lat", "lon",
        F.lit(None).cast("int").alias("vert_rate"), F.lit(None).cast("string").alias("squawk"))


def when(seconds):
    return F.timestamp_micros(F.lit(int((seconds + 1.7e9) * 1000000)))


def test_gap_of_exactly_the_limit_keeps_the_sighting(spark):
    u = updates(spark, [
        ("A", 0.0, 1, "ASA1", None, None, None), ("A", 600.0, 2, None, 100, None, None),
        ("A", 1200.001, 3, None, None, 1.0, 2.0)])
    got = {r.seq: r for r in A.aircraft_track(u).collect()}
    assert (got[2].sighting, got[2].flight, got[2].altitude) == (1, "ASA1", 100)
    assert (got[3].sighting, got[3].flight, got[3].altitude, got[3].lat) == (2, None, None, 1.0)
    assert [r.hex for r in A.live_aircraft(u, when(1800.001)).collect()] == ["A"]
    assert A.live_aircraft(u, when(1800.002)).count() == 0
    assert A.live_aircraft(u, when(700)).first().altitude == 100


def test_track_and_state_equal_a_dictionary(spark):
    """Random updates, tiny blocks: same as keeping one dict per aircraft."""
    rng = random.Random(3)
    rows, t = [], 0.0
    for i in range(600):
        t += rng.choice([1, 30, 200, 599, 601]) / 3
        rows.append((rng.choice("AAAB"), t, i, rng.choice([None, None, f"F{i}"]), rng.choice([None, i]), None, None))
    want, state = {}, {}
    for h, at, seq, flight, alt, _, _ in rows:
        ac = state.get(h)
        if ac is None or at - ac["seen"] > 600:
            ac = {"flight": None, "altitude": None, "no": (ac["no"] if ac else 0) + 1}
        ac = {**ac, "seen": at, **({"flight": flight} if flight else {}), **({"altitude": alt} if alt is not None else {})}
        state[h] = ac
        want[seq] = (ac["no"], ac["flight"], ac["altitude"])
    u = updates(spark, rows).repartition(5)
    for block in (50, 3600):
        got = {r.seq: (r.sighting, r.flight, r.altitude) for r in A.aircraft_track(u, block_s=block).collect()}
        assert got == want
    last = {}
    for h, _, seq, *_ in rows:
        last[h, want[seq][0]] = want[seq]
    got = {(r.hex, r.sighting): (r.sighting, r.flight, r.altitude) for r in A.aircraft_state(u, block_s=50).collect()}
    assert got == last


@pytest.mark.parametrize("text,want", [
    ("good morning Alaska 77 taxi via bravo", ["ASA77"]), ("SKW 5511 contact departure", ["SKW5511"]), ("N77XW report the field", ["N77XW"]),
    ("N8 is number two", ["N8"]), ("information kilo altimeter 29.92", []), ("Horizon 2040 behind the united 9", ["QXE2040", "UAL9"]),
    ("jetblue 615 hold short", ["JBU615"]), ("HAWAIIAN 21 go around", ["HAL21"]), ("FFT 90 FFT  90", ["FFT90"]), ("", []),
    (None, []), ("a last car 7 and you knighted 8 n9ab ILS 34", ["ASA7", "UAL8", "ILS34", "N9AB"]), ("Alaska 41234", []),
])
def test_callsigns(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(A.callsigns("text")).first()[0] == want


def test_match_flights_equals_nested_loop(spark):
    calls = [(1, ["ASA412"]), (2, ["UAL73", "DAL89"]), (3, ["N1", "ASA41"]), (4, []), (5, ["A"]), (6, ["XYZ9999"])]
    flights = [("a", "ASA412  "), ("b", "DAL89   "), ("c", ""), ("d", None), ("e", "ual732"), ("f", "A"), ("g", "xyz9999long name")]
    want = set()
    for tid, cs in calls:
        for h, f in flights:
            key = (f or "").strip().upper()
            hit = next((c for c in cs if key and (c in key or key in c)), None)
            if hit:
                want.add((tid, h, hit))
    c = spark.createDataFrame(calls, "transcript_id bigint, c array<string>").select("transcript_id", F.posexplode("c").alias("pos", "callsign"))
    f = spark.createDataFrame(flights, "hex string, flight string")
    got = {(r.transcript_id, r.hex, r.matched_callsign) for r in A.match_flights(c, f).collect()}
    assert got == want


def test_as_of_uses_the_state_of_the_moment(spark):
    u = updates(spark, [
        ("A", 0.0, 1, "ASA412", None, None, None), ("A", 500.0, 2, None, 900, None, None), ("A", 1000.0, 3, "DAL89", None, None, None),
        ("B", 0.0, 4, "ASA412", None, None, None), ("C", 400.0, 5, None, 5, None, None)])
    t = spark.createDataFrame([(1, 999.0), (2, 1000.0), (3, 600.0), (4, 600.1), (5, 1600.1)], "transcript_id bigint, at double").select(
        "transcript_id", when(0).alias("z"), F.timestamp_micros(((F.col("at") + 1.7e9) * 1000000).cast("bigint")).alias("ts"),
        F.array(F.lit("ASA412"), F.lit("DAL89")).alias("callsigns"))
    got = {(r.transcript_id, r.hex, r.matched_callsign, r.altitude) for r in A.aircraft_as_of(t, A.aircraft_track(u)).collect()}
    assert got == {(1, "A", "ASA412", 900), (2, "A", "DAL89", 900), (3, "A", "ASA412", 900), (3, "B", "ASA412", None), (4, "A", "ASA412", 900)}


def test_registered_matches_reach_transcripts_of_every_day(spark):
    from aetherlog.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.01"
    heard = QUERIES["jn_4_aircraft_as_of"](spark, folder).select("transcript_id", "ts", "hex").collect()
    days = {r.transcript_id: r.ts.date() for r in heard}
    got = QUERIES["jn_3_match_flights_as_of"](spark, folder).collect()
    assert {(r.transcript_id, r.hex) for r in got} == {(r.transcript_id, r.hex) for r in heard}
    assert len({days[r.transcript_id] for r in got}) > 10


def test_texts(spark):
    df = spark.createDataFrame([
        ("A", "ASA1 ", 34960, 150.0, 359.6, 64, "1200"), ("B", None, 940, None, None, None, None), ("C", "", 0, 150.5, 0.0, -64, ""),
    ], "hex string, flight string, altitude int, speed double, track double, vert_rate int, squawk string")
    assert [r.label for r in A.aircraft_labels(df).orderBy("hex").collect()] == ["ASA1 FL350", "B 900ft", "C"]
    d = [r.detail for r in A.aircraft_detail(df).orderBy("hex").collect()]
    assert d[0] == "<b>ASA1</b><br>ICAO: A<br>Alt: 35000<br>Spd: 150 kt<br>Hdg: 360°<br>VS: +64 fpm<br>Squawk: 1200"
    assert d[1] == "<b>B</b><br>ICAO: B<br>Alt: 900<br>Spd: n/a<br>Hdg: n/a"
    assert d[2] == "<b>C</b><br>ICAO: C<br>Alt: ?<br>Spd: 150.5 kt<br>Hdg: 0°<br>VS: -64 fpm"


def test_snapshots(spark):
    prev, cur = (spark.createDataFrame([(h,) for h in hs], "hex string") for hs in ("abc", "bcd"))
    assert [r.hex for r in A.vanished(prev, cur).collect()] == ["a"]
    assert sorted(r.hex for r in A.highlightable(prev, cur).collect()) == ["b", "c"]


def test_live_stream_expires_and_forgets(spark, tmp_path):
    """Batches in order: an aircraft expires, comes back without its old fields."""
    batches = [
        [("A", 0.0, 1, "ASA1", 100, None, None), ("B", 5.0, 2, "DAL2", None, None, None)],
        [("B", 400.0, 3, None, 7, None, None), ("B", 390.0, 4, None, 6, None, None)],
        [("B", 700.0, 5, None, None, 1.0, 2.0)], [("C", 710.0, 7, None, None, None, None)], [("A", 900.0, 6, None, 300, None, None)],
    ]
    for i, rows in enumerate(batches):
        updates(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    schema = updates(spark, batches[0]).schema
    import os
    import time

    for i in range(len(batches)):  # files are taken in the order of their time
        for f in (tmp_path / "in" / f"part={i}").iterdir():
            os.utime(f, (time.time() - 100 + i, time.time() - 100 + i))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = feeds.drained(aircraft.stream_aircraft(s), "live", "update").orderBy("batch_id", "hex").collect()
    a = [(r.flight, r.altitude, r.expired) for r in out if r.hex == "A"]
    b = [(r.flight, r.altitude, r.lat, r.expired) for r in out if r.hex == "B"]
    assert a == [("ASA1", 100, False), ("ASA1", 100, True), (None, 300, False)]
    assert b == [("DAL2", None, None, False), ("DAL2", 7, None, False), ("DAL2", 7, 1.0, False)]


def test_as_of_equals_a_nested_loop_and_shuffles_no_matches(spark):
    rng = random.Random(5)
    names = ["ASA1", "ASA12", "ASA123", "ASA1234", "DAL9", "DAL98", None, "  "]
    rows = [(rng.choice("ABCD"), float(rng.randrange(0, 9000, 7)), i, rng.choice(names), i, None, None) for i in range(400)]
    heard = [(i, float(rng.randrange(0, 9600, 5)), rng.sample(["ASA1", "ASA12", "ASA12345", "DAL9", "DAL987", "N1"], rng.randrange(4))) for i in range(150)]
    track = A.aircraft_track(updates(spark, rows))
    t = spark.createDataFrame(heard + heard[:20], "transcript_id bigint, at double, callsigns array<string>").withColumn(
        "ts", F.timestamp_micros(((F.col("at") + 1.7e9) * 1000000).cast("bigint")))
    out = A.aircraft_as_of(t, track, block_s=50)
    got = sorted((r.transcript_id, r.hex, r.altitude, r.matched_callsign) for r in out.collect())
    states = {h: sorted(((r.ts.timestamp() - 1.7e9, r.seq, r.flight, r.altitude) for r in track.collect() if r.hex == h)) for h in "ABCD"}
    want = []
    for i, at, calls in heard:
        for h, held in states.items():
            s = next((s for s in reversed(held) if s[0] <= at), None)
            if s and at - s[0] <= 600 and s[2] and s[2].strip():
                c = next((c for c in calls if c in s[2].strip() or s[2].strip() in c), None)
                want += [(i, h, s[3], c)] if c else []
    assert got == sorted(want) and len(want) > 60
    # the matches of a busy name grow with its transcripts times its aircraft: nothing above the join moves them again
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = plan[:next(k for k, line in enumerate(plan) if "Join" in line)]
    assert not [line for line in above if any(w in line for w in ("Aggregate", "Window", "Union", "Repartition"))]
    live = spark.createDataFrame([("A",)], "hex string")
    assert {r.hex for r in A.highlightable(A.matched_flights(out), live.union(live)).collect()} == {"A"}


def test_match_events_are_gathered_where_the_matches_are(spark):
    """A busy name's matches grow with its transcripts times its aircraft: none are shuffled to list them by transcript."""
    from aetherlog.plans.catalog import QUERIES

    plan = QUERIES["agg_11_match_events"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(k for k, line in enumerate(plan) if "Join" in line)
    assert any("Aggregate" in line for line in plan[:join]) and not any("Exchange" in line for line in plan[:join])


def test_all_events_leave_the_matches_where_they_are(spark):
    from aetherlog.plans import derived, stream_queries

    events = stream_queries._all_events(derived.Tables(spark, "/root/testdata/sf0.001"))
    plan = events._jdf.queryExecution().executedPlan().toString().splitlines()
    lists = [k for k, line in enumerate(plan) if "collect_list" in line and "partial_" not in line]
    assert lists and not any("Exchange" in line for k in lists for line in plan[k - 3:k + 8] if "transcript_id" in line)


def test_match_events_of_dense_bins_and_repeated_ids(spark, monkeypatch):
    rng = random.Random(9)
    names = ["ASA1", "ASA12", "ASA123", "DAL9", "DAL98", None]
    rows = [(f"H{rng.randrange(12)}", float(rng.randrange(0, 40000, 7)), i, rng.choice(names), i, None, None) for i in range(900)]
    spread = [(i, float(rng.randrange(0, 40000)), rng.sample(["ASA1", "ASA12", "DAL9", "N1"], rng.randrange(4)), "s") for i in range(150)]
    dense = [(1000 + i, float(rng.randrange(20000, 20030)), ["DAL9", "ASA1"], "d") for i in range(300)]
    again = [(i, float(rng.randrange(0, 40000)), ["DAL9"], "a") for i in [*range(0, 60, 3), 1005]]  # a second moment
    none = [(None, 20000.0, ["ASA1"], "n"), (None, 30000.0, ["ASA1"], "n"), (7, None, ["ASA1"], "n")]
    track = A.aircraft_track(updates(spark, rows))
    t = spark.createDataFrame(spread + spread[:9] + dense + again + none, "transcript_id bigint, at double, callsigns array<string>, text string").withColumn(
        "ts", F.timestamp_micros(((F.col("at") + 1.7e9) * 1000000).cast("bigint")))
    matches = A.aircraft_as_of(t, track)
    dealt = []

    class AsOf(A._AsOf):  # as with many tasks
        def __init__(self, *args):
            before = args[0].sparkSession.conf.get("spark.sql.shuffle.partitions")
            args[0].sparkSession.conf.set("spark.sql.shuffle.partitions", "32")
            try:
                super().__init__(*args)
            finally:
                args[0].sparkSession.conf.set("spark.sql.shuffle.partitions", before)
            dealt.append(max(self.shares.values()))
            self.own.conf.set("spark.sql.shuffle.partitions", before)

    monkeypatch.setattr(A, "_AsOf", AsOf)

    def told(rows):
        return sorted((str(r.transcript_id), str(r.text), [(m.hex, m.flight, m.matched_callsign) for m in r.matches]) for r in rows)

    several = [r[0] for r in t.groupBy("transcript_id").agg(F.count_distinct("text").alias("n")).filter("n > 1").collect()]
    for some in (t, t.filter(F.col("transcript_id").isNotNull() & ~F.col("transcript_id").isin([i for i in several if i is not None]))):
        ids = [r[0] for r in some.select("transcript_id").distinct().collect()]
        want = A.match_events(A.matched_flights(matches if some is t else matches.filter(F.col("transcript_id").isin(ids) & F.col("transcript_id").isNotNull())))
        got = A.as_of_events(some, track)
        assert len(ids) > 300 and want.count() > 300
        assert told(got.withColumn("text", F.lit("")).collect()) == told(want.withColumn("text", F.lit("")).collect())
        assert told(A.transcripts_with_events(some, track).collect()) == told(some.join(want, "transcript_id").collect())
    assert min(dealt) > 1  # the dense bin is dealt among several tasks
    assert matches.filter("transcript_id >= 1000").count() > 300
