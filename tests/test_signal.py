"""Audio, frames and segments against brute force and written-out cases."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from aetherlog.operators import signal as S
from aetherlog.plans import chain
from aetherlog.sources import readers
from aetherlog.streaming import feeds, segments

RATE = 16000


def tone(seconds, amp=5000):
    return [int(amp * math.sin(2 * math.pi * 440 * i / RATE)) for i in range(int(seconds * RATE))]


def quiet(seconds):
    return [0] * int(seconds * RATE)


def cuts(silent):
    """Frame by frame: cut at a pause of 3 frames from 10 frames on, else at 150."""
    out, start, run = [], 0, 0
    for i, q in enumerate(silent):
        run = run + 1 if q else 0
        if (run >= 3 and i - start + 1 >= 10) or i - start + 1 >= 150:
            out.append((start, i))
            start, run = i + 1, 0
    return out


@pytest.fixture(scope="module")
def pcm(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pcm")
    cases = {
        "short": tone(0.5), "pause": tone(2) + quiet(0.5), "brief": tone(1.5) + quiet(0.1) + tone(1.5),
        "long": tone(20), "silent": quiet(5), "pieces": tone(3) + quiet(0.5), "odd": tone(1.03),
    }
    for name, samples in cases.items():
        (folder / f"{name}.raw").write_bytes(struct.pack(f"<{len(samples)}h", *samples))
    (folder / "empty.raw").write_bytes(b"")
    return str(folder)


def test_recordings_to_segments(spark, pcm):
    chunks = readers.read_pcm(spark, pcm)
    frames = S.frames(chunks)
    got = {}
    for r in S.vad_segments(frames).collect():
        got.setdefault(r.stream_id.rsplit("/", 1)[1][:-4], []).append((r.start_idx, r.end_idx))
    assert {k: sorted(v) for k, v in got.items()} == {
        "pause": [(0, 22)], "long": [(0, 149)], "pieces": [(0, 32)],
        "silent": [(i, i + 9) for i in range(0, 50, 10)],
    }
    stats = S.segment_stats(frames, S.vad_segments(frames))
    heard = S.filter_signal(stats).collect()
    assert len(heard) == 3 and all(abs(r.audio_s - (r.end_idx - r.start_idx + 1) / 10) < 1e-9 for r in heard)


def test_chunks_keep_every_byte(spark, pcm):
    sizes = {}
    for r in readers.read_pcm(spark, pcm).collect():
        sizes.setdefault(r.stream_id, {})[r.seq] = len(r.pcm)
    odd = next(v for k, v in sizes.items() if k.endswith("odd.raw"))
    assert sum(odd.values()) == int(1.03 * RATE) * 2 and all(n == 4096 for s, n in odd.items() if s < max(odd))
    assert not any(k.endswith("empty.raw") for k in sizes)


def test_frame_rms_and_level(spark, pcm):
    chunks = readers.read_pcm(spark, pcm)
    r = [x for x in S.frames(chunks).collect() if x.stream_id.endswith("long.raw")]
    assert len(r) == 200 and all(abs(x.rms - 5000 / math.sqrt(2)) < 5 for x in r)
    assert max(x.level for x in S.signal_levels(chunks).collect()) < 3700


def test_transcribe_sees_whole_segments(spark, pcm):
    chunks = readers.read_pcm(spark, pcm)
    spans = S.vad_segments(S.frames(chunks))
    out = S.transcribe(S.segment_audio(chunks, spans), lambda: lambda audio: [str(len(a)) for a in audio]).collect()
    assert out and all(int(r.text) == (r.end_idx - r.start_idx + 1) * 3200 for r in out)


@pytest.fixture(scope="module")
def random_streams(spark):
    rng = random.Random(7)
    streams = {}
    for k in range(14):
        p, n = [0, 0.05, 0.1, 0.3, 0.5, 0.9, 1][k % 7], rng.choice([5, 10, 149, 150, 151, 700, 1900])
        streams[f"s{k}"] = [rng.random() < p for _ in range(n)]
    rows = [(s, i, 1600, 1600.0 * (1.0 if q else 1e6), 1.0 if q else 1000.0) for s, v in streams.items() for i, q in enumerate(v)]
    df = spark.createDataFrame(rows, "stream_id string, frame_idx bigint, n int, sumsq double, rms double")
    return streams, df.repartition(6)


@pytest.mark.parametrize("span,fan", [(150, 3), (400, 1024), (9000, 1024)])
def test_vad_equals_frame_by_frame(random_streams, span, fan, monkeypatch):
    streams, df = random_streams
    monkeypatch.setattr(chain, "FAN_IN", fan)
    got = {}
    for r in S.vad_segments(df, block_frames=span).collect():
        got.setdefault(r.stream_id, []).append((r.start_idx, r.end_idx))
    assert {s: sorted(got.get(s, [])) for s in streams} == {s: cuts(v) for s, v in streams.items()}


def test_silence_runs(random_streams):
    streams, df = random_streams
    got = {(r.stream_id, r.frame_idx): r.silence_run for r in S.silence_runs(df, block_frames=11).collect()}
    for s, v in streams.items():
        run = 0
        for i, q in enumerate(v):
            run = run + 1 if q else 0
            assert got[s, i] == run


def test_fixed_segments_are_complete(spark):
    df = spark.range(900).selectExpr("'a' AS stream_id", "id AS frame_idx", "1600 AS n", "1600.0D AS sumsq", "1.0D AS rms")
    got = sorted((r.seg_no, r.start_idx, r.end_idx) for r in S.fixed_segments(df).collect())
    assert got == [(0, 0, 299), (1, 280, 579), (2, 560, 859)]


def test_stream_segments_from_split_shuffled_frames(spark, random_streams, tmp_path):
    """Frames split in two parts and shuffled over batches give the batch result."""
    streams, df = random_streams
    a = df.selectExpr("stream_id", "frame_idx", "600 AS n", "sumsq * 0.375 AS sumsq")
    b = df.selectExpr("stream_id", "frame_idx", "1000 AS n", "sumsq * 0.625 AS sumsq")
    parts = a.union(b)
    parts.repartition(5).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    for r in feeds.drained(segments.stream_vad_segments(s), "vad").collect():
        got.setdefault(r.stream_id, []).append((r.start_idx, r.end_idx))
    assert {k: sorted(got.get(k, [])) for k in streams} == {k: cuts(v) for k, v in streams.items()}
    begun = s.withColumn("started", F.lit("2026-01-01").cast("timestamp"))
    fixed = feeds.drained(segments.stream_fixed_segments(begun, late="1 day"), "fixed", "update").select("stream_id", "seg_no", "start_idx", "end_idx")
    want = S.fixed_segments(df).select("stream_id", "seg_no", "start_idx", "end_idx")
    assert sorted(fixed.collect()) == sorted(want.collect())


def test_a_lost_frame_costs_a_gap(spark, tmp_path):
    """Batch and stream end a run of frames at a lost one and go on behind it; little waits in state."""
    rng = random.Random(8)
    rows, want = [], {}
    for stream, lost in (("a", {0}), ("b", {57, 58, 300}), ("c", set()), ("d", {399})):
        silent = [rng.random() < 0.4 for _ in range(400)]
        rows += [(stream, i, 1600, 0.0 if q else 1600 * 5000.0 ** 2, 0.0 if q else 5000.0) for i, q in enumerate(silent) if i not in lost]
        edges = [-1, *sorted(lost), 400]
        want[stream] = [(a + 1 + s, a + 1 + e) for a, b in zip(edges, edges[1:]) for s, e in cuts(silent[a + 1:b])]
    df = spark.createDataFrame(rows, "stream_id string, frame_idx bigint, n bigint, sumsq double, rms double")
    for block in (160, 9000):
        got = {}
        for r in S.vad_segments(df, block_frames=block).collect():
            got.setdefault(r.stream_id, []).append((r.start_idx, r.end_idx))
        assert {k: sorted(v) for k, v in got.items()} == want
    for low in range(0, 460, 20):  # 23 batches in order, the last ones empty of new frames
        df.filter(F.col("frame_idx").between(low, low + 19)).select("stream_id", "frame_idx", "n", "sumsq").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("stream_id string, frame_idx bigint, n bigint, sumsq double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    for r in feeds.drained(segments.stream_vad_segments(s, late_frames=40), "gaps").collect():
        got.setdefault(r.stream_id, []).append((r.start_idx, r.end_idx))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_fixed_segments_far_behind_are_given_up(spark, tmp_path):
    """In order, every complete segment comes once; one that misses a frame never does, and its late frame changes nothing."""
    frames = [i for i in range(2000) if i != 450]
    for low in range(0, 2000, 250):
        rows = [("a", i, 1600, 1600.0) for i in frames if low <= i < low + 250]
        spark.createDataFrame(rows, "stream_id string, frame_idx bigint, n bigint, sumsq double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", 450, 1600, 1600.0)], "stream_id string, frame_idx bigint, n bigint, sumsq double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("stream_id string, frame_idx bigint, n bigint, sumsq double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = s.withColumn("started", F.lit("2026-01-01").cast("timestamp"))
    got = feeds.drained(segments.stream_fixed_segments(s, late="60 seconds"), "fixed", "update").collect()
    assert sorted(r.seg_no for r in got) == [k for k in range(7) if not (280 * k <= 450 < 280 * k + 300)]
    assert all(r.rms == 1.0 and r.end_idx == r.start_idx + 299 for r in got)


def test_segment_mode(spark):
    modes = {r.id: r.segment_mode for r in S.segment_mode(readers.presets(spark)).collect()}
    assert [k for k, v in modes.items() if v == "fixed"] == ["noaa-seattle", "noaa-monterey", "noaa-portland"]
    odd = spark.createDataFrame([("x", "noaa", None), ("y", None, 0)], "id string, parser string, squelch int")
    assert {r.segment_mode for r in S.segment_mode(odd).collect()} == {"vad"}
