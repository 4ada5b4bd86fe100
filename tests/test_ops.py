"""Metrics, edges, presets, tuning history, sinks."""

import random

from pyspark.sql import functions as F

from aetherlog.operators import aviation as A
from aetherlog.operators import control as C
from aetherlog.operators import metrics as M
from aetherlog.operators import transcripts as T
from aetherlog.plans.blocked import index_block, running
from aetherlog.sources import readers, sinks
from aetherlog.streaming import feeds

T0 = 1_772_000_000


def log(spark, rows, schema):
    df = spark.createDataFrame([(r[0], i, *r[1:]) for i, r in enumerate(rows)], f"station string, seq bigint, {schema}")
    return df.withColumn("ts", F.timestamp_micros((F.col("seq") * 700 + T0) * 1000000))


def test_running_kinds_equal_plain_windows(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.choice([None, 1, 2]), rng.random() < 0.2) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint, r boolean").repartition(4)
    got = running(df, ["k"], ["i"], index_block("i", 13), s=("sum", F.col("v")), l=("last", F.col("v")), b=("before", F.col("v")),
                  g=("lag", F.col("v")), d=("lead", F.col("v")), c=("since", F.lit(1), F.col("r")))
    got = {(r.k, r.i): (r.s, r.l, r.b, r.g, r.d, r.c) for r in got.collect()}
    for k in "ab":
        seq = [r for r in rows if r[0] == k]
        total, last, since = 0, None, 0
        for n, (_, i, v, reset) in enumerate(seq):
            before = last
            total, last = total + (v or 0), v if v is not None else last
            since = 0 if reset else since + 1
            lag, lead = seq[n - 1][2] if n else None, seq[n + 1][2] if n + 1 < len(seq) else None
            assert got[k, i] == (total, last, before, lag, lead, since)


def test_crashes(spark):
    kinds = ["crash", "ok", "crash", "crash", "crash", "reconnect", "crash", "ok", "crash"]
    got = M.crash_sequences(log(spark, [("s", k) for k in kinds], "kind string")).orderBy("seq").collect()
    assert [(r.crash_no, r.action) for r in got] == [
        (1, "retry"), (2, "retry"), (3, "retry"), (4, "exhausted"), (1, "retry"), (2, "retry")]


def test_edges(spark):
    flags = [False, True, True, False, False, True, False]
    df = log(spark, [("s", f, f) for f in flags], "running boolean, sdr_connected boolean")
    assert [r.seq for r in M.stop_edges(df).orderBy("seq").collect()] == [3, 6]
    got = [(r.seq, r.event) for r in M.connection_edges(df).orderBy("seq").collect()]
    assert got == [(0, "sdr_disconnected"), (1, "sdr_reconnected"), (3, "sdr_disconnected"), (5, "sdr_reconnected"), (6, "sdr_disconnected")]


def test_inference(spark):
    df = spark.createDataFrame(
        [("a", False, 20, 100.0, 400.0, 2.0), ("a", True, None, None, None, None), ("a", False, 5, None, 0.0, 0.0), ("b", True, None, None, None, None)],
        "stream_id string, skipped boolean, tokens int, encoder_ms double, decoder_ms double, audio_s double")
    got = {r.stream_id: (r.chunks_processed, r.chunks_skipped_silence, r.total_tokens) for r in M.inference_totals(df).collect()}
    assert got == {"a": (2, 1, 25), "b": (0, 1, 0)}
    assert {r.stream_id: r.silence_pct for r in M.silence_pct(df).collect()} == {"a": 33, "b": 100}
    assert M.silence_pct(df.limit(0), []).first().silence_pct == 0
    m = sorted((r.tokens_per_sec, r.rtf) for r in M.inference_metrics(df).collect())
    assert m == [(0.0, 0.0), (50.0, 0.25)]


def sessions(events):
    """One receiver, step by step."""
    tuned, apt, saved, out = None, False, None, []

    def note(i):
        out.append([i, None, None if apt else tuned, apt])

    for i, (kind, preset) in enumerate(events):
        if kind == "tune" and not apt:
            tuned = preset
        elif kind == "stop" and not apt:
            tuned = None
        elif kind == "apt_enter" and not apt:
            apt, saved = True, tuned
        elif kind == "apt_exit" and apt:
            apt, tuned = False, saved
        else:
            continue
        if out:
            out[-1][1] = i
        note(i)
    return [tuple(s) for s in out if s[2] is not None or s[3]]


def test_tuning_sessions_equal_a_receiver(spark):
    rng = random.Random(9)
    events = [(rng.choice(["tune", "tune", "stop", "apt_enter", "apt_exit", "note"]), f"p{i}") for i in range(250)]
    df = log(spark, [("s", k, p if k == "tune" else None) for k, p in events], "kind string, preset_id string")
    for block in (800, 3600):
        rows = C.tuning_sessions(df, block_s=block).collect()
        no = lambda t: None if t is None else int((t.timestamp() - T0) // 700)
        got = sorted((no(r.start_ts), no(r.end_ts), r.preset_id, r.satellite_mode) for r in rows)
        assert [(a, b, c, d) for a, b, c, d in got] == sessions(events)


def test_preset_as_of(spark):
    tune = log(spark, [("s", "p0"), ("s", None), ("s", "p2")], "preset_id string")
    seg = spark.createDataFrame([("s", 0, -5), ("s", 1, 0), ("s", 2, 699), ("s", 3, 700), ("s", 4, 9999), ("x", 5, 0)], "station string, seq bigint, s bigint")
    seg = seg.withColumn("ts", F.timestamp_micros((F.col("s") + T0) * 1000000)).select("station", "ts", "seq", "s")
    got = {r.seq: (r.preset_id, r.s) for r in C.preset_as_of(seg, tune).collect()}
    assert got == {0: (None, -5), 1: ("p0", 0), 2: ("p0", 699), 3: (None, 700), 4: ("p2", 9999), 5: (None, 0)}


def test_presets(spark):
    p, c = readers.presets(spark), readers.categories(spark)
    by = {r.category: [x.id for x in r.presets] for r in C.presets_by_category(p.filter("category <> 'marine'"), c).collect()}
    assert {k: len(v) for k, v in by.items()} == {"weather": 3, "aviation": 6, "marine": 0, "public_safety": 2, "broadcast": 2}
    assert C.available_presets(p, "WEBSTREAM").count() == 6 and C.available_presets(p, "SDR").count() == 15
    s = spark.createDataFrame([("fm", None, None, -5), ("am", "1M", True, 150), (None, "", None, 30)], "mode string, sample_rate string, deemp boolean, squelch int")
    got = [(r.effective_sample_rate, r.effective_deemp, r.effective_squelch) for r in C.effective_tuning(s).collect()]
    assert got == [("200k", True, 0), ("1M", True, 100), ("200k", False, 30)]


def test_view_rules(spark):
    s = spark.createDataFrame([("adsb-1090", True), ("ksea-tower", True), ("ksea-tower", False), ("noaa-seattle", True), (None, True)], "preset_id string, adsb_enabled boolean")
    got = {(r.preset_id, r.adsb_enabled): (r.map_panel, r.transcript_visible, r.weather_panel, r.correlation) for r in C.view_rules(s, readers.presets(spark)).collect()}
    assert got == {
        ("adsb-1090", True): ("full", False, False, False), ("ksea-tower", True): ("shown", True, False, True),
        ("ksea-tower", False): ("hidden", True, False, False), ("noaa-seattle", True): ("hidden", True, True, False),
        (None, True): ("hidden", True, False, False)}


def test_weather_feed_writes_each_batch_once(spark, tmp_path):
    t = spark.createDataFrame([("1", "noaa-seattle", "SDR", "a gale warning for skagit today")], "stream_id string, preset_id string, source string, text string")
    t = t.withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    handler = feeds.weather_handler(readers.presets(spark), str(tmp_path))
    handler(t, 0)
    handler(t, 0)  # the same batch again, as after a failure
    events = spark.read.parquet(str(tmp_path / "events"))
    assert sorted(r.event for r in events.collect()) == ["priority_alert", "weather_update"]
    row = spark.read.parquet(str(tmp_path / "alert_log")).first()
    assert (row.freq, row["type"], row["name"], row.area) == ("162.550M", "warning", "Gale Warning", "Skagit")


def test_events_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, None)], "station string, running int, note string").withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    sinks.write_events(sinks.as_events(df, "status", "station", "ts", ["running", "note"]), str(tmp_path / "e"))
    r = spark.read.parquet(str(tmp_path / "e")).first()
    assert (r.event, r.key, r.payload) == ("status", "x", '{"running":1}')
    u = readers.union_sources(radio=df.select("station", "running"), web=df.select("station"))
    assert sorted((r.source, r.running is None) for r in u.collect()) == [("radio", False), ("web", True)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.txt").write_bytes(b"  MSG,1 \r\n\n \t\nMSG,\xff2\n")
    assert [r.value for r in readers.read_sbs(spark, str(tmp_path / "l")).orderBy("seq").collect()] == ["MSG,1", "MSG,�2"]


def test_telemetry_files_to_aircraft(spark, tmp_path):
    """Text files, lines an hour apart, up to the state at the moment of a transcript."""
    line = "MSG,3,1,1,a1b2c3,1,2026/03/01,{0},2026/03/01,{0},{1},{2},,,,,,\n"
    (tmp_path / "one.txt").write_text(line.format("10:00:00.000", "QXE21 ", "") + line.format("10:00:05.250", "", "4100"))
    (tmp_path / "two.txt").write_text(line.format("11:00:00.000", "", "900") + "MSG,3,1,1,FFFFFF,1,x,y,,,NOTIME,\n")
    lines = readers.read_sbs(spark, str(tmp_path))
    assert lines.columns == ["value", "ts", "seq", "file"]
    track = A.aircraft_track(A.parse_sbs(lines))
    known = track.filter("hex = 'A1B2C3'").orderBy("ts").collect()
    assert [(r.ts.isoformat(), r.flight, r.altitude, r.sighting) for r in known] == [
        ("2026-03-01T10:00:00", "QXE21", None, 1), ("2026-03-01T10:00:05.250000", "QXE21", 4100, 1), ("2026-03-01T11:00:00", None, 900, 2)]
    t = spark.createDataFrame([(1, "2026-03-01 10:00:04", "qxe 21 hello"), (2, "2026-03-01 10:09:00", "QXE 21"), (3, "2026-03-01 11:00:01", "QXE 21")],
                              "transcript_id int, t string, text string").withColumn("ts", F.to_timestamp("t"))
    t = t.withColumn("text", F.upper("text"))
    got = {r.transcript_id: r.altitude for r in A.aircraft_as_of(A.extract_callsigns(t), track).collect()}
    assert got == {1: None, 2: 4100}
    streamed = feeds.drained(readers.read_sbs(spark, str(tmp_path), streaming=True, max_files_per_trigger=1), "sbs")
    assert sorted(streamed.select("ts", "seq").collect()) == sorted(lines.select("ts", "seq").collect())


def test_newest_catalogue_reads_one_file(spark, tmp_path):
    import os

    for i, name in enumerate(("b.txt", "a.txt", "c.txt")):
        (tmp_path / name).write_text(f"NAME {name}\n1 x\n\n2 y\n")
        os.utime(tmp_path / name, (1000 + (i == 1) * 500, 1000 + (i == 1) * 500))
    got = readers.read_tle(spark, str(tmp_path))
    assert [r.value for r in got.orderBy("line_no").collect()] == ["NAME a.txt", "1 x", "2 y"]
    assert len(got.inputFiles()) == 1


def test_only_weather_presets_give_reports(spark):
    rows = [("s", "ksea-tower", "watch for traffic on final"), ("s", "noaa-seattle", "\t watch for traffic on final  "),
            ("s", None, "a gale warning for skagit today"), ("s", "no-such-preset", "gale warning"), ("s", "noaa-seattle", "thank you."),
            ("s", "noaa-portland", "quiet seas and sun for all of the week")]
    t = spark.createDataFrame(rows, "stream_id string, preset_id string, text string").withColumns({
        "ts": F.lit("2026-01-01").cast("timestamp"), "source": F.lit("SDR")})
    reports = T.heard_reports(t, readers.presets(spark)).withColumn("banner", T.active_banner())
    got = {r.raw_transcript: r for r in reports.collect()}
    assert set(got) == {"watch for traffic on final", "quiet seas and sun for all of the week"}
    loose = got["watch for traffic on final"]
    # a loose word hides the old banner and shows the raw text; no word, no banner
    assert loose.alerts == [] and loose.banner == "watch for traffic on final" and loose.freq == "162.550M"
    assert got["quiet seas and sun for all of the week"].banner is None
    events = [(r.event, r.payload) for r in sinks.weather_events(reports).collect()]
    assert sorted(e for e, _ in events) == ["priority_alert", "weather_update", "weather_update"]
    alert = next(p for e, p in events if e == "priority_alert")
    assert alert == ('{"alerts":[],"raw_snippet":"watch for traffic on final","timestamp":"2026-01-01T00:00:00.000000Z","freq":"162.550M","source":"SDR"}')
    assert T.alert_log(reports).count() == 0


def test_equal_requests_each_get_an_answer(spark):
    at = lambda c: F.to_timestamp(c)
    req = spark.createDataFrame([("s", "2026-01-01 10:00:00", "kexp-fm")] * 2 + [("s", "2026-01-01 10:30:00", "kexp-fm"), ("x", "2026-01-01 10:10:00", "kexp-fm"),
        ("s", "2026-01-01 11:00:00", "kexp-fm"), ("s", "2026-01-01 10:20:00", "?")], "station string, t string, preset_id string").select("station", at("t").alias("ts"), "preset_id")
    locks = spark.createDataFrame([("s", "2026-01-01 10:00:00", "2026-01-01 11:00:00"), ("s", "2026-01-01 10:25:00", "2026-01-01 10:26:00")], "station string, a string, b string")
    locks = locks.select("station", at("a").alias("lock_start"), at("b").alias("lock_end"))
    for block in (60, 3600):
        out = C.validate_requests(req, readers.presets(spark), locks, block_s=block).collect()
        assert sorted((r.station, r.ts.minute + 60 * r.ts.hour, r.reason) for r in out) == [
            ("s", 600, "locked"), ("s", 600, "locked"), ("s", 620, "unknown_preset"), ("s", 630, "locked"), ("s", 660, "ok"), ("x", 610, "ok")]


def test_recent_transcripts_limit_below_the_shuffle(spark):
    t = spark.range(50).selectExpr("cast(id % 2 AS string) AS stream_id", "timestamp_seconds(id) AS ts", "id")
    t = t.withColumn("raw_transcript", F.when(F.col("id") != 49, "said").otherwise(""))
    out = T.recent_transcripts(t, 3)
    assert sorted(r.id for r in out.collect()) == [43, 44, 45, 46, 47, 48]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_transcripts_wait_for_their_telemetry(spark, tmp_path):
    """A transcript comes before the telemetry of its moment and is matched all the same."""
    schema = "hex string, ts timestamp, seq bigint, flight string, altitude int, speed double, track double, lat double, lon double, vert_rate int, squawk string"
    at = lambda s: f"2026-03-01 10:00:{s:02d}"

    def states(*rows):
        df = spark.createDataFrame([(h, at(s), i, f) for i, (h, s, f) in enumerate(rows)], "hex string, t string, seq bigint, flight string")
        none = {c.split(" ")[0]: F.lit(None).cast(c.split(" ")[1]) for c in schema.split(", ")[4:]}
        return df.withColumn("ts", F.to_timestamp("t")).drop("t").withColumns(none).select(*[c.split(" ")[0] for c in schema.split(", ")])

    def said(*rows):
        return spark.createDataFrame([(i, at(s), x) for i, s, x in rows], "transcript_id int, t string, text string").withColumn("ts", F.to_timestamp("t")).drop("t")

    tracks, path = str(tmp_path / "track"), str(tmp_path / "out")
    states(("A1", 1, "QXE21")).write.parquet(tracks)
    track = lambda: spark.read.schema(schema).parquet(tracks)
    handler = feeds.callsign_handler(track, path, late_s=2)
    handler(said((1, 0, "QXE 21"), (2, 5, "QXE 21"), (3, 20, "SKW 7 hello"), (4, 6, "nothing")), 0)
    found = lambda: sorted((r.transcript_id, r.hex) for r in spark.read.parquet(f"{path}/matches").collect())
    assert found() == []  # the table only reaches second 1
    states(("B2", 19, "SKW7"), ("A1", 21, None)).write.mode("append").parquet(tracks)
    for _ in range(2):  # the second time as after a failure
        handler(said((5, 30, "SKW 7")), 1)
    assert found() == [(2, "A1")]
    feeds.match_waiting(track(), path, 1)
    assert found() == [(2, "A1"), (3, "B2"), (5, "B2")]


def test_edges_across_batches(spark, tmp_path):
    rows = [("x", 0, True, "kexp-fm"), ("y", 0, False, None), ("x", 1, False, "kexp-fm"), ("x", 2, False, "kexp-fm"), ("y", 2, True, None), ("x", 3, True, "?"), ("x", 4, False, "?")]
    df = log(spark, [(s, r, p) for s, _, r, p in rows], "running boolean, preset_id string")
    handler = feeds.edge_handler(readers.presets(spark), str(tmp_path))
    for batch, (a, b) in enumerate(((0, 0), (1, 2), (2, 2), (3, 6))):
        handler(df.filter(F.col("seq").between(a, b)) if batch != 2 else df.limit(0), batch)
    handler(df.filter(F.col("seq").between(3, 6)), 3)
    got = spark.read.parquet(f"{tmp_path}/events").orderBy("ts").collect()
    assert [(r.key, int(r.ts.timestamp() - T0) // 700, r.payload) for r in got] == [("x", 2, '{"rms":0.0,"freq":"90.300M"}'), ("x", 6, '{"rms":0.0,"freq":""}')]


def test_dense_blocks_are_cut_by_rows(spark):
    """One station has a third of a dense hour: no part of a block holds much more than the setting, results are the same."""
    from aetherlog.plans import blocked

    rng = random.Random(4)
    rows = [("hot", rng.randrange(600), i) for i in range(3000)] + [(rng.choice("abcdef"), rng.randrange(7200), 3000 + i) for i in range(3000)]
    df = spark.createDataFrame(rows, "station string, s bigint, seq bigint").withColumn("ts", F.timestamp_micros((F.col("s") + T0) * 1000000))
    df = df.withColumn("kind", F.when(F.col("seq") % 5 == 0, "crash").when(F.col("seq") % 31 == 0, "reconnect").otherwise("ok"))
    up = df.select(F.col("station").alias("hex"), "ts", "seq", F.when(F.col("seq") % 7 == 0, F.col("seq").cast("string")).alias("flight"), *[
        F.lit(None).cast(t).alias(c) for c, t in (("altitude", "int"), ("speed", "double"), ("track", "double"), ("lat", "double"), ("lon", "double"), ("vert_rate", "int"), ("squawk", "string"))])

    def results():
        crashes = sorted((r.station, r.seq, r.crash_no) for r in M.crash_sequences(df).collect())
        track = sorted((r.hex, r.seq, r.sighting, r.flight or "") for r in A.aircraft_track(up).collect())
        return crashes, track

    plain = results()
    for limit in (20, 100, 1000):
        spark.conf.set(blocked.ROWS_PER_BLOCK, str(limit))
        try:
            assert results() == plain
            parts = blocked.cut_dense(df.withColumn(blocked.BLOCK, blocked.time_block("ts")), ["station"], "ts")
            largest = parts.groupBy("station", blocked.BLOCK).count().agg(F.max("count")).first()[0]
            assert largest <= 2 * limit + 20
        finally:
            spark.conf.unset(blocked.ROWS_PER_BLOCK)
