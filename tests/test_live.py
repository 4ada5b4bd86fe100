"""Late rows, table functions, displays, containment and back-ends."""

import random

import numpy as np
from pyspark.sql import functions as F

from aetherlog.operators import aviation as A
from aetherlog.operators import signal as S
from aetherlog.operators import tablefunctions
from aetherlog.operators import transcripts as T
from aetherlog.sources import readers
from aetherlog.streaming import feeds, late, stations


def test_late_rows_are_kept_apart(spark, tmp_path):
    schema, folder, checkpoint, out = "station STRING, ts TIMESTAMP, n INT, late STRING", str(tmp_path / "in"), str(tmp_path / "c"), str(tmp_path / "out")
    batches = [[("a", 100, 1), ("a", 10, 2), ("b", 5, 3)], [("a", 89, 4), ("a", 90, 5), ("b", 200, 6), ("a", None, 7)], [("b", 150, 8), ("a", 300, 9), ("c", 1, 10)],
               [("a", 89, 11), (None, 1, 12)]]
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = late.mark_late(spark.readStream.schema(schema).parquet(folder).drop("late"), ["station"], 10)
    for rows in batches:
        df = spark.createDataFrame(rows, "station STRING, s BIGINT, n INT")
        df.select("station", F.timestamp_seconds("s").alias("ts"), "n", F.lit("x").alias("late")).write.mode("append").parquet(folder)
        feeds.start(stream, on_batch=late.split_handler(out), checkpoint=checkpoint).awaitTermination()
    main = {r.n for r in spark.read.parquet(f"{out}/rows").collect()}
    behind = {r.n: r.behind_s for r in spark.read.parquet(f"{out}/late").collect()}
    assert main == {1, 2, 3, 5, 6, 9, 10, 12} and set(behind) == {4, 7, 8, 11}
    assert behind[4] == 11 and behind[8] == 50 and behind[11] == 211


def test_table_function_equals_the_batch_segments(spark):
    rng = np.random.default_rng(6)
    rows = []
    for name, seconds in (("a", 40), ("b", 3), ("c", 0.05)):
        loud = np.repeat(rng.random(int(seconds * 10) + 1) < 0.6, 1600)[:int(seconds * 16000)]
        rows.append((name, bytearray(np.where(loud, rng.integers(-3000, 3000, len(loud)), 0).astype("<i2").tobytes() + b"x")))
    chunks = readers.pcm_chunks(spark.createDataFrame(rows, "stream_id STRING, content BINARY")).repartition(5)
    want = sorted(tuple(r) for r in S.vad_segments(S.frames(chunks)).select("stream_id", "start_idx", "end_idx").collect())
    for block in (151, 9000):
        assert sorted(tuple(r) for r in tablefunctions.segments_of_chunks(chunks, block_frames=block).collect()) == want
    assert len(want) > 8
    spark.sql("SELECT 1").count()
    n = spark.sql("SELECT count(*) AS n FROM chunk_cuts(TABLE(SELECT *, 0L AS blk FROM {c}) PARTITION BY (stream_id, blk) ORDER BY (seq), 9000, 400.0D, 4096)", c=chunks).first().n
    assert n == sum(len(b) // 3200 for _, b in rows)


def test_names_meet_as_in_a_nested_loop(spark):
    rng = random.Random(8)
    names = {"".join(rng.choice("AB1") for _ in range(rng.randrange(1, 12))) for _ in range(150)} | {"ASA123", "ASA12", "XASA1234", "A", "é", "1"}
    long = "".join(rng.choice("AB1") for _ in range(10_000))
    calls, flights = sorted(names | {long, ""}), sorted({n[1:] for n in names if len(n) > 1} | {"ASA1234", long[500:9000], "zz", None}, key=str)
    got = {tuple(r) for r in A.matching_names(spark.createDataFrame([(c,) for c in calls] * 2, "callsign STRING"),
                                              spark.createDataFrame([(f,) for f in flights], "flight_key STRING")).collect()}
    assert got == {(c, f) for c in calls if c for f in flights if f and (c in f or f in c)}
    assert (long, long[500:9000]) in got and len(got) > 500


def test_a_name_makes_rows_in_proportion_to_its_length(spark):
    n = 4000
    df = spark.createDataFrame([("x" * n + str(i),) for i in range(3)], "long STRING")
    most = df.select(F.size(A._pieces("long", 1, 5)).alias("a"), F.size(A._pieces("long", 6, 6)).alias("b")).first()
    assert most.a + most.b <= 6 * (n + 1)


def test_backends_in_turn(spark, tmp_path):
    made = str(tmp_path / "made")
    rows = [(i, [bytearray(b"ab" * k)]) for i, k in enumerate([800, 900, 80000, 81000, 80500, 0])] + [(9, None)]
    df = spark.createDataFrame(rows, "id INT, pieces ARRAY<BINARY>").coalesce(1)

    def missing():
        with open(made, "a") as f:
            f.write("x")
        raise OSError("none here")

    def brief():
        def fn(audio):
            if max(map(len, audio)) > 100_000:
                raise ValueError("too long")
            return [f"brief {len(a)}" for a in audio]
        return fn
    out = {r.id: (r.text, r.backend) for r in S.transcribe_with(
        df, [("npu", missing), ("brief", brief), ("cpu", lambda: lambda audio: [f"{len(audio)} of {len(a)}" for a in audio])], batch=2).collect()}
    assert out[0] == ("brief 1600", "brief") and out[1] == ("brief 1800", "brief")
    assert {out[i][0] for i in (2, 3, 4)} == {"2 of 160000", "2 of 162000", "1 of 161000"} and out[3][1] == "cpu"
    assert out[5] == out[9] == (None, "none")
    assert open(made).read() == "x"  # made once, not tried again
    none = S.transcribe_with(df, [("npu", missing)]).collect()
    assert {(r.text, r.backend) for r in none} == {(None, "none")}


def test_displays_follow_the_newest_reports(spark, tmp_path):
    rng = random.Random(9)
    texts = ["a gale warning for skagit today and tonight", "quiet seas and sun for all of the week", "watch for snow over the passes today"]
    rows = [(f"s{rng.randrange(3)}", "noaa-seattle", 1000 + rng.randrange(500), i, rng.choice(texts)) for i in range(40)]
    t = spark.createDataFrame(rows, "stream_id STRING, preset_id STRING, s BIGINT, transcript_id BIGINT, text STRING").withColumns(
        {"ts": F.timestamp_seconds("s"), "source": F.lit("SDR")})
    for n in range(4):  # in any order of time
        t.filter(F.col("transcript_id") % 4 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    presets = readers.presets(spark)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    shown = feeds.drained(stations.stream_displays(T.heard_reports(stream, presets), 3), "displays", "update")
    last = shown.groupBy("stream_id").agg(F.max("batch_id").alias("batch_id"))
    got = sorted((r.stream_id, r.rn, r.transcript_id, r.banner is None) for r in shown.join(last, ["stream_id", "batch_id"]).collect())
    want = []
    for s in sorted({r[0] for r in rows}):
        newest = sorted((r[2], r[3], r[4]) for r in rows if r[0] == s)[::-1]
        hidden = "watch" not in newest[0][2] and "warning" not in newest[0][2]
        want += [(s, k + 1, i, hidden) for k, (_, i, _) in enumerate(newest[:3])]
    assert got == want and shown.count() > len(want)


def test_highlights_go_out(spark, tmp_path):
    df = spark.createDataFrame([(1, "A1", "ASA1", 50)], "transcript_id INT, hex STRING, matched_callsign STRING, s BIGINT").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.state, r.at.second) for r in stations.stream_highlights(df, 8).collect()}
    assert got == {("on", 50), ("off", 58)}


def test_audio_is_handed_over_in_parts(spark):
    n = 3 << 20
    rows = [(i, [bytearray([i]) * n, bytearray(b"xy")]) for i in range(6)] + [(6, [])]
    df = spark.createDataFrame(rows, "id INT, pieces ARRAY<BINARY>").coalesce(1)
    out = {r.id: r.text for r in S.transcribe(df, lambda: lambda audio: [f"{a[:1].hex()} {len(a)} {sum(map(len, audio))}" for a in audio]).collect()}
    assert [out[i].split(" ")[:2] for i in range(7)] == [[f"0{i}", str(n + 2)] for i in range(6)] + [["", "0"]]
    assert max(int(x.split(" ")[2]) for x in out.values()) <= S._AUDIO_BYTES


def test_a_stream_of_made_rows_is_not_shuffled(spark):
    from aetherlog.plans.stream_queries import _stream_of

    df = spark.range(1000, numPartitions=10)
    stream = _stream_of(df, "made", 3, spread=False)
    batches = feeds.drained(stream.withColumn("n", F.lit(1)).groupBy("id").agg(F.sum("n").alias("n")), "made-out", "update")
    assert sorted(r.id for r in batches.select("id").collect()) == list(range(1000)) and batches.select("batch_id").distinct().count() == 3
