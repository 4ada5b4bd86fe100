"""Recordings read in ranges, numbered lines, current-state tables and committed events."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from aetherlog import schemas
from aetherlog.operators import aviation as A
from aetherlog.operators.metrics import latest
from aetherlog.sources import readers, recordings, sinks, tables
from aetherlog.streaming import correlation, feeds


# --- recordings ------------------------------------------------------------------------------

def test_one_recording_is_read_by_several_tasks(spark, tmp_path):
    body = random.Random(1).randbytes(3 * 8 * 4096 - 1000)
    (tmp_path / "long.raw").write_bytes(body)
    (tmp_path / "_draft").write_bytes(b"x" * 5000)
    df = readers.read_pcm(spark, str(tmp_path), block_bytes=8 * 4096)
    assert df.rdd.getNumPartitions() == 3
    rows = df.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(24)) and b"".join(r.pcm for r in rows) == body
    assert {r.stream_id for r in rows} == {f"file://{tmp_path}/long.raw"} and [len(r.pcm) for r in rows] == [4096] * 23 + [3096]
    one = readers.read_pcm(spark, f"file://{tmp_path}/long.raw", chunk_bytes=1000)
    assert one.count() == -(-len(body) // 1000)


def test_empty_folder_has_no_chunks(spark, tmp_path):
    assert readers.read_pcm(spark, str(tmp_path)).count() == 0


def test_growing_recordings(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    body = random.Random(2).randbytes(10 * 4096 + 700)

    def run(quiet_s):
        stream = readers.read_pcm(spark, str(folder), streaming=True, block_bytes=2 * 4096, max_bytes_per_trigger=3 * 4096, quiet_s=quiet_s)
        q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.parquet(out).orderBy("seq").collect()
        return [r.seq for r in rows], b"".join(bytes(r.pcm) for r in rows)

    def until(n, quiet_s=3600):
        for _ in range(8):
            seen = run(quiet_s)
            if len(seen[0]) >= n:
                return seen
        return seen
    (folder / "a.raw").write_bytes(body[:4 * 4096 + 100])
    assert until(4) == (list(range(4)), body[:4 * 4096])             # the short end waits
    with open(folder / "a.raw", "ab") as f:
        f.write(body[4 * 4096 + 100:])
    assert until(10) == (list(range(10)), body[:10 * 4096])
    os.utime(folder / "a.raw", (time.time() - 100, time.time() - 100))
    assert until(11, quiet_s=50) == (list(range(11)), body)


def test_written_recordings_come_back(spark, tmp_path):
    df = spark.createDataFrame([("x", bytearray(b"ab" * 3000)), ("y", bytearray()), (None, bytearray(b"z"))], "stream_id STRING, content BINARY")
    recordings.write_recordings(df, str(tmp_path / "r"))
    recordings.write_recordings(df, f"file://{tmp_path}/r")  # again: replaced
    assert sorted(os.listdir(tmp_path / "r")) == ["x.raw", "y.raw"]
    assert sorted(len(r.pcm) for r in readers.read_pcm(spark, str(tmp_path / "r")).collect()) == [1904, 4096]


# --- lines -----------------------------------------------------------------------------------

def test_line_numbers_over_splits(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for name in ("a.txt", "b.txt"):
        lines = ["x" * rng.randrange(0, 90) + f" {i}" if rng.random() < 0.9 else rng.choice(["", " \t", "\r"]) for i in range(3000)]
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "a.txt" else ""), newline="")
        want[name] = [(i, x.strip()) for i, x in enumerate(lines) if x.strip()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = readers.read_sbs(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {}
    for r in df.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.seq, r.value))
    assert {k: sorted(v) for k, v in got.items()} == want


# --- tables ----------------------------------------------------------------------------------

STATE = "station STRING, seq BIGINT, ts TIMESTAMP, level INT"


def state(spark, rows):
    return spark.createDataFrame(rows, "station STRING, seq BIGINT, level INT").withColumn("ts", F.timestamp_seconds(F.col("seq") / 2)).select(
        "station", "seq", F.col("ts").cast("timestamp").alias("ts"), "level")


def seen(spark, path, version=None):
    return {r.station: (r.seq, r.level) for r in tables.current(spark, path, STATE, version).collect()}


def test_upserts_equal_the_batch_result(spark, tmp_path):
    rng, path, everything = random.Random(4), str(tmp_path / "t"), []
    assert seen(spark, path) == {}
    for batch_id in range(4):
        rows = [(f"s{rng.randrange(12)}", rng.randrange(1000), rng.randrange(99)) for _ in range(15)]
        everything += rows
        p = tables.upsert(state(spark, rows), path, ["station"], ["ts", "seq", "level"], batch_id, buckets=5)
        want = {r.station: (r.seq, r.level) for r in latest(state(spark, everything), ["station"], ["ts", "seq", "level"]).collect()}
        assert seen(spark, path) == want and p.batch_id == batch_id
    assert seen(spark, path, 2) != want                              # an earlier version can still be read
    again = tables.upsert(state(spark, [("s0", 5000, 1)]), path, ["station"], ["ts", "seq", "level"], 3, buckets=5)
    assert seen(spark, path) == want and again == p                 # a batch that is in the table changes nothing
    assert tables.vacuum(spark, path, keep=1) > 0 and seen(spark, path) == want


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    first = tables.upsert(state(spark, [(f"s{i}", 1, 1) for i in range(40)]), path, ["station"], ["ts", "seq"], 0, buckets=8)
    second = tables.upsert(state(spark, [("s3", 2, 2)]), path, ["station"], ["ts", "seq"], 1, buckets=8)
    assert sum(first.parts[b] != second.parts[b] for b in first.parts) == 1 and len(first.parts) > 4
    assert seen(spark, path)["s3"] == (2, 2) and len(seen(spark, path)) == 40
    empty = tables.upsert(state(spark, [("s0", 1, 1)]).limit(0), path, ["station"], ["ts", "seq"], 2, buckets=8)
    assert empty.parts == second.parts and empty.batch_id == 2


def test_a_batch_that_dies_before_its_pointer_shows_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.upsert(state(spark, [("a", 1, 1)]), path, ["station"], ["ts", "seq"], 0, buckets=2)
    with monkeypatch.context() as m:
        m.setattr(tables, "_move", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            tables.upsert(state(spark, [("a", 2, 2), ("b", 1, 1)]), path, ["station"], ["ts", "seq"], 1, buckets=2)
    assert seen(spark, path) == {"a": (1, 1)}
    tables.upsert(state(spark, [("a", 3, 3), ("b", 1, 1)]), path, ["station"], ["ts", "seq"], 1, buckets=2)
    assert seen(spark, path) == {"a": (3, 3), "b": (1, 1)}


# --- events ----------------------------------------------------------------------------------

def test_uncommitted_events_are_not_read(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = [("error", f"s{i}", None, "{}") for i in range(20)] + [("mode", "s", None, "{}")]
    spark.createDataFrame(rows, schemas.EVENTS).repartition(2).write.parquet(source)
    stream = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    sinks.stream_events(stream, out, checkpoint).awaitTermination()
    # what a batch leaves that died between its files and its commit
    spark.createDataFrame(rows, schemas.EVENTS).drop("event").coalesce(1).write.parquet(f"{out}/event=error/x")
    stray = next((tmp_path / "out" / "event=error" / "x").glob("part-*"))
    stray.rename(tmp_path / "out" / "event=error" / "part-00000-stray.snappy.parquet")
    assert sinks.read_events(spark, out).count() == 21 and sinks.read_events(spark, out, "mode").count() == 1
    spark.createDataFrame(rows[:3], schemas.EVENTS).write.mode("append").parquet(source)
    sinks.stream_events(stream, out, checkpoint).awaitTermination()
    assert sinks.read_events(spark, out, "error").count() == 23


# --- transcripts and aircraft as streams ---------------------------------------------------------

def test_streamed_matches_equal_the_batch_result(spark, tmp_path):
    """Random states and transcripts; states up to ten minutes late, flights that change, garbled names."""
    rng, day = random.Random(5), 1_772_000_000
    names = ["ASA12", "ASA123", "UAL7", " dal9 ", None, "", "N5AB", "ASA12345678"]
    track = sorted((day + rng.randrange(20000), f"H{rng.randrange(6)}", rng.choice(names), rng.randrange(999)) for _ in range(400))
    said = [(i, day + rng.randrange(20000), rng.choice(["ASA 123 hello", "UAL 7 and DAL 9", "N5AB", "nothing", "asa", "ASA 12", None])) for i in range(80)]
    t_schema, s_schema = "transcript_id INT, ts TIMESTAMP, text STRING", f"hex STRING, ts TIMESTAMP, seq BIGINT, {', '.join(f'{n} {k}' for n, k in correlation._FIELDS.items())}"
    states = spark.createDataFrame([(h, s, i, f, a, None, None, None, None, None, None) for i, (s, h, f, a) in enumerate(track)],
                                   s_schema.replace("TIMESTAMP", "BIGINT")).withColumn("ts", F.timestamp_seconds("ts"))
    heard = spark.createDataFrame(said, t_schema.replace("TIMESTAMP", "BIGINT")).withColumn("ts", F.timestamp_seconds("ts"))
    want = sorted((r.transcript_id, r.hex, r.seen, r.matched_callsign, r.altitude) for r in A.aircraft_as_of(A.extract_callsigns(heard), states).collect())
    streams = []
    for df, name, delay in ((heard, "t", F.lit(0)), (states, "s", F.when(F.col("seq") % 4 == 0, 600).otherwise(0))):
        for n in range(5):
            arrives = F.unix_seconds("ts") + delay - day
            part = df.filter((arrives >= n * 4500) & (arrives < (n + 1) * 4500))
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name / "x"))
        end = spark.createDataFrame([(None,)], "hex STRING").select(*[
            (F.lit(day + 10 ** 6).cast("timestamp") if f.name == "ts" else F.lit("9" if f.name in ("hex", "transcript_id") else None)).cast(f.dataType).alias(f.name)
            for f in df.schema])
        end.write.mode("append").parquet(str(tmp_path / name / "x"))
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "x")))
    out = feeds.drained(correlation.stream_callsign_matches(*streams, late="20 minutes"), "matches")
    got = sorted((r.transcript_id, r.hex, r.seen, r.matched_callsign, r.altitude) for r in out.collect())
    assert got == want and len(want) > 40


def test_short_spans_share_tasks():
    from aetherlog.sources import recordings as R

    few = [R.Span(f"f{i}", f"f{i}", 0, 0, 4096) for i in range(5)]
    assert [p.spans for p in R._shared(few, 4096)] == [[s] for s in few]  # a small folder is split as asked
    many = [R.Span(f"f{i // 2}", f"f{i // 2}", 0, i % 2 * 4096, (i % 2 + 1) * 4096) for i in range(20_000)]
    tasks = R._shared(many, 4096)
    assert [s for p in tasks for s in p.spans] == many and len(tasks) <= 2 * R._TASKS
    large = [R.Span("f", "f", 0, i * R.BLOCK_BYTES, (i + 1) * R.BLOCK_BYTES) for i in range(2000)]
    assert len(R._shared(large, R.BLOCK_BYTES)) == 2000
