"""Table functions: one chunk of audio in, any number of rows out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from aetherlog import dims
from aetherlog.plans.blocked import index_block
from aetherlog.plans.chain import follow_chain
from aetherlog.plans.store import stored

FUNCTION = "chunk_cuts"
_FRAME_BYTES = 2 * dims.FRAME_SAMPLES


class ChunkCuts:
    """For each frame that begins in a block of chunks: the frame after the cut, if a segment began there.

    Called with ``TABLE(..) PARTITION BY (stream_id, blk) ORDER BY seq`` over rows ``(stream_id, blk, seq, pcm)`` and the block's
    frames, the silence threshold and the bytes of a chunk. A block gets the chunks it owns and those its last segments reach into.
    A gap in the chunks ends the frames before it.
    """

    def __init__(self) -> None:
        self.chunks: list[tuple[int, bytes]] = []
        self.asked: tuple | None = None

    def eval(self, row: Row, block_frames: int, silence: float, chunk_bytes: int) -> None:
        self.asked = (row["stream_id"], row["blk"], block_frames, silence, chunk_bytes)
        self.chunks.append((row["seq"], bytes(row["pcm"])))

    def terminate(self) -> Iterator[tuple]:
        if self.asked is None:
            return
        stream, blk, block_frames, silence, chunk_bytes = self.asked
        seqs = np.array([s for s, _ in self.chunks])
        for part in np.split(np.arange(len(seqs)), np.flatnonzero(np.diff(seqs) != 1) + 1):
            offset = int(seqs[part[0]]) * chunk_bytes
            lead = -offset % _FRAME_BYTES
            body = b"".join(self.chunks[i][1] for i in part)[lead:]
            n = len(body) // _FRAME_BYTES
            if not n:
                continue
            x = np.frombuffer(body[:n * _FRAME_BYTES], "<i2").astype(np.float64).reshape(n, -1)
            quiet = np.sqrt((x * x).sum(axis=1) / dims.FRAME_SAMPLES) < silence
            first, at = (offset + lead) // _FRAME_BYTES, np.arange(n)
            run = at - np.maximum.accumulate(np.where(quiet, -1, at))
            pauses = np.flatnonzero(run >= dims.HOLDOFF_FRAMES)
            # the first pause that is long enough after each start, else the longest segment
            nth = np.searchsorted(pauses, at + dims.MIN_SEGMENT_FRAMES - 1)
            pause = np.append(pauses, n + dims.MAX_SEGMENT_FRAMES)[nth]
            end = np.minimum(pause, at + dims.MAX_SEGMENT_FRAMES - 1)
            for f in np.flatnonzero((first + at) // block_frames == blk).tolist():
                yield stream, first + f, int(first + end[f] + 1) if end[f] < n else None


def register(spark: SparkSession) -> None:
    """Make the function known to SQL as ``chunk_cuts``."""
    spark.udtf.register(FUNCTION, F.udtf(ChunkCuts, returnType="stream_id STRING, frame_idx BIGINT, next_start BIGINT"))


def segments_of_chunks(
    chunks: DataFrame, silence: float = dims.SILENCE_RMS, block_frames: int = 9000, chunk_bytes: int = dims.CHUNK_BYTES,
) -> DataFrame:
    """Voice-activity segments ``(stream_id, start_idx, end_idx)`` straight from chunks ``(stream_id, seq, pcm)``.

    The table function runs per stream and block, so no stream is one task; the blocks' cuts are then followed from block to block. A block
    borrows the chunks of the frames that its last segment may reach, and of the two frames before it that a pause may begin in.
    """
    spark = chunks.sparkSession
    register(spark)
    first = F.floor(F.col("seq") * chunk_bytes / _FRAME_BYTES)
    last = F.floor(((F.col("seq") + 1) * chunk_bytes - 1) / _FRAME_BYTES)
    low, high = index_block(first - dims.MAX_SEGMENT_FRAMES, block_frames), index_block(last + dims.HOLDOFF_FRAMES, block_frames)
    spread = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), "seq", "pcm",
                           F.explode(F.sequence(F.greatest(low, F.lit(0).cast("bigint")), high)).alias("blk"))
    cuts = spark.sql(
        f"SELECT stream_id, frame_idx, next_start FROM {FUNCTION}(TABLE(SELECT * FROM {{spread}}) PARTITION BY (stream_id, blk) ORDER BY (seq), "
        f"{int(block_frames)}, {float(silence)}D, {int(chunk_bytes)})", spread=spread)
    # written once, as the chain reads its rows several times, and each time the function would run over all audio again
    chain = follow_chain(stored(cuts, "cuts"), ["stream_id"], "frame_idx", "next_start", dims.MAX_SEGMENT_FRAMES, block_frames)
    return chain.filter(F.col("next_start").isNotNull()).select(
        "stream_id", F.col("frame_idx").alias("start_idx"), (F.col("next_start") - 1).alias("end_idx"))
