"""How much queries keep, shuffle or ask for, per row: figures that must not grow faster than the input."""

import random

from pyspark.sql import functions as F

from aetherlog.operators import aviation as A
from aetherlog.operators import signal as S
from aetherlog.operators import tablefunctions
from aetherlog.streaming import correlation, feeds, segments


def test_names_meet_on_few_keys(spark):
    rng = random.Random(3)
    names = {"".join(rng.choice("AB1") for _ in range(rng.randrange(1, 10))) for _ in range(150)} | {"ASA1234", "SA12", "Ü1", "ÄÜ1ö-ß", "N100AB"}
    df = spark.createDataFrame([(n,) for n in sorted(names)], "name STRING")
    keys = lambda role, other: {r.name: set(r.k) for r in df.select("name", correlation.name_keys("name", role, other).alias("k")).collect()}
    c, f = keys("c", "f"), keys("f", "c")
    for a in names:
        for b in names:
            if a in b or b in a:
                assert c[a] & f[b], (a, b)
            if len(a) >= 4 and len(b) >= 4 and a[:4] not in b and b[:4] not in a:
                assert not c[a] & f[b], (a, b)
    assert len(c["ASA1234"]) == 11 and len(c["N100AB"]) == 8


def test_live_table_reads_the_updates_once(spark):
    rng, day, ttl = random.Random(8), 1_772_000_000, 300
    rows = [(rng.choice(["A", "B", "C", "D", None]), None if i % 40 == 0 else day + rng.randrange(6000), i,
             *(x if rng.random() < 0.3 else None for x in (f"F{i}", i, i / 2, i / 3, 47.0, -122.0 + i, i, str(i)))) for i in range(120)]
    fields = "flight STRING, altitude INT, speed DOUBLE, track DOUBLE, lat DOUBLE, lon DOUBLE, vert_rate INT, squawk STRING"
    u = spark.createDataFrame(rows, f"hex STRING, s BIGINT, seq BIGINT, {fields}").select("hex", F.timestamp_seconds("s").alias("ts"), "seq", *[f.split()[0] for f in fields.split(", ")])
    for now in (day, day + 1500, day + 2999, day + 6000, day + 6400):
        want = {}
        for h in "ABCD":
            seen = sorted((r[1], r[2], r[3:]) for r in rows if r[0] == h and r[1] is not None and r[1] <= now)
            if not seen or now - seen[-1][0] > ttl:
                continue
            first = max(i for i in range(len(seen)) if i == 0 or seen[i][0] - seen[i - 1][0] > ttl)
            state = [None] * 8
            for _, _, v in seen[first:]:
                for k in (0, 1, 2, 3, 6, 7):
                    state[k] = v[k] if v[k] is not None else state[k]
                if v[4] is not None and v[5] is not None:
                    state[4:6] = v[4:6]
            want[h] = (*state, seen[-1][0])
        for block in (None, 60):
            live = A.live_aircraft(u, F.timestamp_seconds(F.lit(now)), ttl, **({"block_s": block} if block else {}))
            got = {r[0]: tuple(r)[1:] for r in live.withColumn("seen", F.unix_seconds("seen")).collect()}
            assert got == want
    assert live._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_short_streams_share_a_group(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for stream in [None, *range(60)]:
        for session in ("a", None):
            size = rng.choice([0, 1, 5, 40, 400]) if stream is None or stream % 7 == 0 else 0
            rows += [(stream, session, i, 1600, 1600 * rng.choice([0.0, 1e6]), rng.randrange(4)) for i in range(size)]
            rows += [(stream, session, size, 700, 1.0, rng.randrange(4))]  # part of a frame
    df = spark.createDataFrame(rows, "stream_id BIGINT, session STRING, frame_idx BIGINT, n INT, sumsq DOUBLE, slice INT")
    for i in range(4):
        df.filter(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.drop("slice").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = feeds.drained(segments.stream_vad_segments(stream, ["stream_id", "session"], 100.0, shares=3), "shares")
    assert out.schema["stream_id"].dataType.simpleString() == "bigint"
    got = {(r.stream_id, r.session, r.start_idx, r.end_idx) for r in out.collect()}
    key = F.concat_ws("/", F.coalesce(F.col("stream_id").cast("string"), F.lit("-")), F.coalesce("session", F.lit("-")))
    whole = df.filter("n = 1600").select(key.alias("stream_id"), "frame_idx", "n", "sumsq", F.sqrt(F.col("sumsq") / F.col("n")).alias("rms"))
    want = {tuple(r) for r in S.vad_segments(whole, threshold=100.0).collect()}
    assert {(f"{'-' if a is None else a}/{b or '-'}", c, d) for a, b, c, d in got} == want and len(want) > 20


def test_table_function_runs_once(spark):
    chunks = spark.createDataFrame([("a", i, bytes(4096)) for i in range(40)], "stream_id STRING, seq BIGINT, pcm BINARY")
    out = tablefunctions.segments_of_chunks(chunks)
    assert "PythonUDTF" not in out._jdf.queryExecution().executedPlan().toString() and out.count() > 0
