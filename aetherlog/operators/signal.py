"""Signal analytics: frame energy, silence, segmentation.

Audio arrives as chunk rows ``(stream_id, seq, pcm)``. Only the sample decode
needs Python (one Arrow UDF); everything after it works on one row per
100 ms frame and stays in the JVM.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aetherlog import dims
from aetherlog.plans.bins import BIN, bin_of
from aetherlog.plans.blocked import index_block, numbered, running
from aetherlog.plans.chain import follow_chain

FRAME_BLOCK = 9000  # frames per block: 15 minutes


# --- energy ------------------------------------------------------------------------

@F.arrow_udf(T.ArrayType(T.DoubleType()))
def frame_energy(pcm: pa.Array, first_sample: pa.Array) -> pa.Array:
    """Sum of squares per 100 ms frame a chunk touches, first frame first. Samples are read where they lie in the batch."""
    size = dims.FRAME_SAMPLES
    out = [np.empty(0)]
    for raw, first in zip(pcm, first_sample.to_numpy()):
        body = raw.as_buffer()
        x = np.frombuffer(body, dtype="<i2", count=body.size // 2).astype(np.float64)
        cuts = np.append(0, np.arange(size - first % size, len(x), size))
        out.append(np.add.reduceat(x * x, cuts) if len(x) else np.empty(0))
    edges = np.cumsum([len(x) for x in out], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(out)))


def rms(sumsq: str | Column, n: str | Column) -> Column:
    """Root mean square from a sum of squares; 0 for no samples."""
    sumsq, n = (F.col(c) if isinstance(c, str) else c for c in (sumsq, n))
    return F.when(n > 0, F.sqrt(sumsq / n)).otherwise(0.0)


def frame_parts(chunks: DataFrame, key: str = "stream_id", chunk_bytes: int = dims.CHUNK_BYTES) -> DataFrame:
    """Partial frames ``(key, seq, frame_idx, n, sumsq)`` of each chunk; works on streams too.

    Chunks are ``chunk_bytes`` long except the last, so the first sample of
    chunk ``seq`` is known without looking at its neighbours.
    """
    size = dims.FRAME_SAMPLES
    placed = chunks.select(
        key, "seq", (F.col("seq") * (chunk_bytes // 2)).alias("first"),
        F.floor(F.length("pcm") / 2).alias("samples"), "pcm")
    parts = placed.select(
        key, "seq", "first", "samples", F.posexplode(frame_energy("pcm", "first")).alias("at", "sumsq"),
    ).withColumn("frame_idx", F.floor(F.col("first") / size).cast("bigint") + F.col("at"))
    begins = F.greatest(F.col("first"), F.col("frame_idx") * size)
    ends = F.least(F.col("first") + F.col("samples"), (F.col("frame_idx") + 1) * size)
    return parts.select(key, "seq", "frame_idx", (ends - begins).alias("n"), "sumsq")


def frames(chunks: DataFrame, key: str = "stream_id", chunk_bytes: int = dims.CHUNK_BYTES) -> DataFrame:
    """Whole frames of each stream. Frames straddle chunks, so partial sums are merged."""
    merged = frame_parts(chunks, key, chunk_bytes).groupBy(key, "frame_idx").agg(
        F.sum("n").cast("int").alias("n"), F.sum("sumsq").alias("sumsq"))
    return merged.filter(F.col("n") == dims.FRAME_SAMPLES).withColumn("rms", rms("sumsq", "n"))


def signal_levels(chunks: DataFrame) -> DataFrame:
    """Level of each full chunk: RMS of its last 4096 bytes, one decimal."""
    tail = F.expr(f"substring(pcm, -{dims.CHUNK_BYTES})")
    parts = frame_energy(tail, F.lit(0).cast("bigint"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, part: a + part)
    return (
        chunks.filter(F.length("pcm") >= dims.CHUNK_BYTES)
        .withColumn("level", F.round(rms(total, F.lit(dims.CHUNK_BYTES // 2)), 1))
        .drop("pcm")
    )


def filter_signal(segments: DataFrame, threshold: float = dims.SIGNAL_RMS) -> DataFrame:
    return segments.filter(F.col("rms") > threshold)


# --- silence and segmentation ----------------------------------------------------------

def silence_runs(
    f: DataFrame, key: list[str] = ["stream_id"], threshold: float = dims.SILENCE_RMS,
    block_frames: int = 36000,
) -> DataFrame:
    """Number of consecutive silent frames up to and including each frame."""
    idx = F.col("frame_idx")
    loud = F.when(F.col("rms") >= threshold, idx)
    first = F.lit(0).cast("bigint")
    out = running(f, key, ["frame_idx"], index_block("frame_idx", block_frames), _loud=("last", loud))
    return out.withColumn("silence_run", idx - F.coalesce("_loud", first - 1)).drop("_loud")


def vad_cuts(
    f: DataFrame, key: list[str] = ["stream_id"], threshold: float = dims.SILENCE_RMS,
    block_frames: int = FRAME_BLOCK,
) -> DataFrame:
    """For every frame: the frame after the cut, if a segment started here.

    A segment of 10 to 150 frames ends at the first frame whose last three
    frames are silent, else at 150 frames. That depends on at most 149 frames
    ahead and 2 behind, so each block only borrows those from its neighbours.
    """
    lo, hi, hold = dims.MIN_SEGMENT_FRAMES - 1, dims.MAX_SEGMENT_FRAMES - 1, dims.HOLDOFF_FRAMES - 1
    idx, blk = F.col("frame_idx"), index_block("frame_idx", block_frames)
    reach = F.array_distinct(F.array(
        blk, index_block(idx - hi, block_frames), index_block(idx + hold, block_frames)))
    spread = (
        f.select(*key, "frame_idx", (F.col("rms") < threshold).alias("silent"), blk.alias("own"), F.explode(reach).alias("blk"))
        .filter(F.col("blk") >= 0)
    )
    back = Window.partitionBy(*key, "blk").orderBy(F.desc("frame_idx"))
    quiet = F.col("silent")
    for n in range(1, dims.HOLDOFF_FRAMES):
        quiet = quiet & F.coalesce(F.lead("silent", n).over(back), F.lit(False))
    marked = spread.withColumn("quiet_at", F.when(quiet, idx))
    ahead = marked.withColumn("next_quiet", F.min("quiet_at").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    reached = ahead.withColumns({
        "quiet_cut": F.lag("next_quiet", lo).over(back),
        "forced_cut": F.lag("frame_idx", hi).over(back),
    })
    cut = F.when(F.col("quiet_cut") <= idx + hi, F.col("quiet_cut")).otherwise(F.col("forced_cut"))
    return reached.filter(F.col("own") == F.col("blk")).select(*key, "frame_idx", (cut + 1).alias("next_start"))


def vad_segments(
    f: DataFrame, key: list[str] = ["stream_id"], threshold: float = dims.SILENCE_RMS,
    block_frames: int = FRAME_BLOCK,
) -> DataFrame:
    """Voice-activity segments ``(key, start_idx, end_idx)``, end inclusive.

    A missing frame ends a run of frames as the end of a stream does; the next run is cut on its own.
    """
    place = numbered(f.select(*key, "frame_idx", "rms"), key, ["frame_idx"], index_block("frame_idx", block_frames), "_place")
    runs, own = place.withColumn("_run", F.col("frame_idx") - F.col("_place")).drop("_place"), [*key, "_run"]
    cuts = vad_cuts(runs, own, threshold, block_frames)
    chain = follow_chain(cuts, own, "frame_idx", "next_start", dims.MAX_SEGMENT_FRAMES, block_frames)
    return chain.filter(F.col("next_start").isNotNull()).select(
        *key, F.col("frame_idx").alias("start_idx"), (F.col("next_start") - 1).alias("end_idx"))


def fixed_segments(
    f: DataFrame, key: list[str] = ["stream_id"],
    segment_s: int = dims.FIXED_SEGMENT_S, overlap_s: int = dims.FIXED_OVERLAP_S,
) -> DataFrame:
    """Complete overlapping segments of fixed length, counted from the first sample."""
    length, step = segment_s * 10, (segment_s - overlap_s) * 10
    idx = F.col("frame_idx")
    first = F.greatest(F.lit(0), F.floor((idx - length) / step) + 1).cast("bigint")
    last = F.floor(idx / step).cast("bigint")
    spread = f.withColumn("seg_no", F.explode(F.sequence(first, last)))
    per = spread.groupBy(*key, "seg_no").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("n").alias("_n"), F.sum("sumsq").alias("_s"))
    start = F.col("seg_no") * step
    return per.filter(F.col("frames") == length).select(
        *key, "seg_no", start.alias("start_idx"), (start + length - 1).alias("end_idx"),
        rms("_s", "_n").alias("rms"))


def segment_stats(f: DataFrame, segments: DataFrame, key: list[str] = ["stream_id"], width: int = 150) -> DataFrame:
    """Energy and duration of each segment, joined to its frames through bins."""
    ids = [*key, "start_idx", "end_idx"]
    touched = F.sequence(bin_of(F.col("start_idx"), width), bin_of(F.col("end_idx"), width))
    spans = segments.select(*ids).withColumn(BIN, F.explode(touched))
    points = f.select(*key, "frame_idx", "n", "sumsq").withColumn(BIN, bin_of(F.col("frame_idx"), width))
    hit = points.join(spans, [*key, BIN]).filter(F.col("frame_idx").between(F.col("start_idx"), F.col("end_idx")))
    per = hit.groupBy(*ids).agg(F.sum("n").alias("samples"), F.sum("sumsq").alias("_s"))
    return per.select(
        *ids, rms("_s", "samples").alias("rms"),
        (F.col("samples") / F.lit(dims.SAMPLE_RATE)).alias("audio_s"))


def segment_mode(presets: DataFrame) -> DataFrame:
    """Which segmentation a preset gets: fixed for continuous weather broadcasts."""
    continuous = (F.col("parser") == "noaa") & (F.coalesce("squelch", F.lit(-1)) == 0)
    return presets.withColumn("segment_mode", F.when(F.coalesce(continuous, F.lit(False)), "fixed").otherwise("vad"))


# --- segment audio for a transcription backend ---------------------------------------------

def segment_audio(
    chunks: DataFrame, segments: DataFrame, key: list[str] = ["stream_id"], chunk_bytes: int = dims.CHUNK_BYTES,
) -> DataFrame:
    """The bytes of each segment, as ordered chunk slices; at most 30 s per segment. Chunks are ``chunk_bytes`` long."""
    size, frame_bytes = chunk_bytes, dims.FRAME_SAMPLES * 2
    lo, hi = F.col("start_idx") * frame_bytes, (F.col("end_idx") + 1) * frame_bytes
    spans = segments.withColumn("seq", F.explode(F.sequence(
        F.floor(lo / size).cast("bigint"), F.floor((hi - 1) / size).cast("bigint"))))
    at = F.col("seq") * size
    begin = F.greatest(lo - at, F.lit(0)).cast("int")
    stop = F.least(hi - at, F.lit(size)).cast("int")
    cut = spans.join(chunks.select(*key, "seq", "pcm"), [*key, "seq"]).withColumn(
        "piece", F.substring("pcm", begin + 1, stop - begin))
    return cut.groupBy(*segments.columns).agg(
        F.sort_array(F.collect_list(F.struct("seq", "piece"))).alias("p")
    ).select(*segments.columns, F.col("p.piece").alias("pieces"))


_AUDIO_BYTES = 8 << 20  # that a backend is handed at once, or one longer segment


def _audio(rows: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in parts of bounded audio, each with the joined bytes of its segments: a batch may hold gigabytes."""
    first, size, audio = 0, 0, []
    for i, pieces in enumerate(rows.column("pieces")):
        body = b"".join(x.as_buffer() for x in pieces.values) if pieces.is_valid else b""
        if audio and size + len(body) > _AUDIO_BYTES:
            yield rows.slice(first, i - first), audio
            first, size, audio = i, 0, []
        audio.append(body)
        size += len(body)
    if audio:
        yield rows.slice(first), audio


def transcribe(segments: DataFrame, make_fn) -> DataFrame:
    """Run a transcription backend over segment audio (``pieces`` -> ``text``).

    ``make_fn`` is called once per task and returns ``fn(list[bytes]) -> list[str]``;
    load a model there, not per batch. Silent segments should be filtered first.
    """
    keep = [c for c in segments.columns if c != "pieces"]
    ddl = ", ".join([f"`{c}` {segments.schema[c].dataType.simpleString()}" for c in keep] + ["text string"])

    def run(batches):
        fn = make_fn()
        for batch, audio in (part for rows in batches for part in _audio(rows)):
            text = pa.array(fn(audio), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [text], names=[*keep, "text"])

    return segments.mapInArrow(run, ddl)


def transcribe_with(segments: DataFrame, backends: list[tuple], bucket_s: float = 5.0, batch: int = 32) -> DataFrame:
    """Like :func:`transcribe` with a chain of backends: adds ``text`` and ``backend``, the name of the one that did it (else ``none``).

    ``backends`` holds ``(name, make_fn)`` in the order of preference. Each is made once per task, when it is first needed; one that cannot be
    made is not tried again. Segments are handed over in batches of at most ``batch`` of about one length (``bucket_s``), so that a model pads
    little. A batch that a backend fails on goes to the next one. A segment without audio has no text.
    """
    keep = [c for c in segments.columns if c != "pieces"]
    ddl = ", ".join([f"`{c}` {segments.schema[c].dataType.simpleString()}" for c in keep] + ["text string", "backend string"])
    width = max(int(bucket_s * dims.SAMPLE_RATE) * 2, 1)

    def run(batches):
        made: dict[int, object] = {}

        def said(audio: list[bytes]) -> tuple[list, str]:
            for i, (name, make_fn) in enumerate(backends):
                try:
                    if i not in made:
                        made[i] = None
                        made[i] = make_fn()
                    if made[i] is not None and len(text := list(made[i](audio))) == len(audio):
                        return text, name
                except Exception as e:  # any backend's failure is the next one's turn
                    logging.getLogger(__name__).warning("backend %s: %s", name, e)
            return [None] * len(audio), "none"

        for rows, audio in (part for batch in batches for part in _audio(batch)):
            text, by = [None] * len(audio), ["none"] * len(audio)
            lengths: dict[int, list[int]] = {}
            for i, a in enumerate(audio):
                if a:
                    lengths.setdefault(len(a) // width, []).append(i)
            for _, at in sorted(lengths.items()):
                for k in range(0, len(at), batch):
                    part = at[k:k + batch]
                    texts, name = said([audio[i] for i in part])
                    for i, x in zip(part, texts):
                        text[i], by[i] = x, name
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + [pa.array(text, pa.string()), pa.array(by)], names=[*keep, "text", "backend"])

    return segments.mapInArrow(run, ddl)
