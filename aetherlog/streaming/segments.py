"""Incremental segmentation: counters per stream are kept, never audio.

Input rows are partial frames ``(key..., frame_idx, n, sumsq)`` as decoded from
chunks. They may come split, out of order, and in any batches: a frame waits in
state until it is whole and its turn has come, or until too many later ones have come, so the
segments are those of the batch operators. Put the tuning session into the key and no segment mixes presets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aetherlog import dims

_NEW = (0, 0, 0, 0, 0.0)  # counters of a stream of which no frame was taken: next, start, quiet, n, sumsq


class VadSegments(StatefulProcessor):
    """Cuts at a pause once a segment is long enough, or at the longest length.

    A frame that has not come when one ``late`` frames behind it has is given up: the run of frames ends there as at
    the end of a stream, and the next run begins with the next whole frame. So at most ``late``
    frames of a stream wait in state; frames that come after they were given up are left out.

    A group is a share of the streams, as each call and each look at the state store costs far more than the work on a short stream: the
    rows of all its streams are added up together, and only streams of which a frame can be taken are looked at one by one.
    """

    def __init__(self, silence: float, late: int):
        self.silence, self.late = silence, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a share's parts of frames and its streams' counters, packed column by column; names one a line
        self.waiting = handle.getValueState("parts", "name STRING, at BINARY, n BINARY, sumsq BINARY")
        self.open = handle.getValueState("open", "name STRING, counters BINARY, sumsq BINARY")

    def _held(self) -> tuple[dict[str, tuple], list[pd.DataFrame]]:
        state, parts = {}, []
        if held := self.open.get():
            counters, sums = np.frombuffer(held[1], np.int64).reshape(-1, 4).tolist(), np.frombuffer(held[2]).tolist()
            state = {name: (*c, x) for name, c, x in zip(held[0].split("\n"), counters, sums)}
        if held := self.waiting.get():
            parts.append(pd.DataFrame({
                "name": held[0].split("\n"), "frame_idx": np.frombuffer(held[1], np.int64), "n": np.frombuffer(held[2], np.int64),
                "sumsq": np.frombuffer(held[3])}))
        return state, parts

    def _keep(self, state: dict[str, tuple], name: np.ndarray, at: np.ndarray, n: np.ndarray, sumsq: np.ndarray) -> None:
        if state:
            counters = np.array([s[:4] for s in state.values()], np.int64)
            self.open.update(("\n".join(state), counters.tobytes(), np.array([s[4] for s in state.values()]).tobytes()))
        if len(at):
            self.waiting.update(("\n".join(name), at.tobytes(), n.tobytes(), sumsq.tobytes()))
        else:
            self.waiting.clear()

    def _cut(self, state: tuple, n: np.ndarray, sumsq: np.ndarray) -> tuple[tuple, list[tuple]]:
        """Take whole frames that follow the state's last one; segments that end in them."""
        first, start, quiet, open_n, open_s = state
        silent = np.sqrt(sumsq / n) < self.silence
        at = np.arange(len(n))
        loud = np.maximum.accumulate(np.where(silent, -1, at))
        run = np.where(loud < 0, quiet + at + 1, at - loud)
        pauses = first + np.flatnonzero(run >= dims.HOLDOFF_FRAMES)
        total_n, total_s = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0.0], np.cumsum(sumsq)])
        last, done, out = first + len(n) - 1, 0, []
        while True:
            i = np.searchsorted(pauses, max(start + dims.MIN_SEGMENT_FRAMES - 1, first))
            end = start + dims.MAX_SEGMENT_FRAMES - 1
            end = min(int(pauses[i]), end) if i < len(pauses) else end
            if end > last:
                break
            upto = end + 1 - first
            seg_n, seg_s = open_n + total_n[upto] - total_n[done], open_s + total_s[upto] - total_s[done]
            out.append((start, end, float(np.sqrt(seg_s / seg_n)), float(seg_n / dims.SAMPLE_RATE)))
            start, done, open_n, open_s = end + 1, upto, 0, 0.0
        state = (last + 1, start, int(run[-1]), int(open_n + total_n[-1] - total_n[done]), float(open_s + total_s[-1] - total_s[done]))
        return state, out

    def _take(self, state: tuple, at: np.ndarray, n: np.ndarray, sumsq: np.ndarray) -> tuple[tuple, list[tuple], int]:
        """Take what can be taken of one stream's frames: the new state, the segments that ended, and how many frames are done with."""
        done, out = 0, []
        while done < len(at):
            ready = (at[done:] == state[0] + np.arange(len(at) - done)) & (n[done:] == dims.FRAME_SAMPLES)
            m = len(ready) if ready.all() else int(np.argmin(ready))
            if m:
                state, found = self._cut(state, n[done:done + m], sumsq[done:done + m])
                out += found
                done += m
            elif at[-1] - state[0] >= self.late:
                whole = np.flatnonzero((n[done:] == dims.FRAME_SAMPLES) & (at[done:] > state[0]))
                skip = int(whole[0]) if len(whole) else int(np.searchsorted(at[done:], at[-1] - self.late, "right"))
                done += skip
                restart = int(at[done]) if done < len(at) else int(at[-1]) + 1
                state = (restart, restart, 0, 0, 0.0)
            else:
                break
        return state, out, done

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, parts = self._held()
        for pdf in rows:  # sums per frame, so that a split frame stays one row
            parts.append(pdf.groupby(["name", "frame_idx"], as_index=False)[["n", "sumsq"]].sum())
        merged = pd.concat(parts).groupby(["name", "frame_idx"], as_index=False)[["n", "sumsq"]].sum()  # in the order of both
        name, at = merged["name"].to_numpy(object), merged["frame_idx"].to_numpy(np.int64)
        n, sumsq = merged["n"].to_numpy(np.int64), merged["sumsq"].to_numpy(float)
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        size = np.diff(np.append(first, len(at)))
        turn = np.array([state.get(x, _NEW)[0] for x in name[first]], np.int64)
        rest = at >= np.repeat(turn, size)  # frames that were given up are left out
        last = first + size - 1
        skip = np.add.reduceat(~rest, first)
        head = np.minimum(first + skip, last)
        act = (skip < size) & ((at[head] == turn) & (n[head] == dims.FRAME_SAMPLES) | (at[last] - turn >= self.late))
        out: list[tuple] = []
        for i in np.flatnonzero(act).tolist():
            lo, hi = int(head[i]), int(last[i]) + 1
            state[name[lo]], found, done = self._take(state.get(name[lo], _NEW), at[lo:hi], n[lo:hi], sumsq[lo:hi])
            rest[lo:lo + done] = False
            out += [(name[lo], *f) for f in found]
        self._keep(state, name[rest], at[rest], n[rest], sumsq[rest])
        if out:
            yield pd.DataFrame(out, columns=["name", "start_idx", "end_idx", "rms", "audio_s"])

    def close(self) -> None:
        pass


def stream_vad_segments(
    parts: DataFrame, key: list[str] = ["stream_id"], silence: float = dims.SILENCE_RMS, late_frames: int = dims.LATE_FRAMES, shares: int = 512,
) -> DataFrame:
    """Voice-activity segments of a stream of (partial) frames; a lost frame costs a gap (see ``VadSegments``).

    The streams are dealt over ``shares`` groups by their key. A batch reads and writes the state of the groups it has rows of, so there should be
    as many shares as keep a share's streams at some thousands. The number stays what it was when the stream began.
    """
    # the key as one line of text: JSON, in which a NULL differs from any value
    name = F.to_json(F.array(*[F.col(k).cast("string") for k in key]))
    rows = parts.select(name.alias("name"), "frame_idx", "n", "sumsq").withColumn("_share", F.pmod(F.xxhash64("name"), F.lit(shares)))
    out = rows.groupBy("_share").transformWithStateInPandas(
        statefulProcessor=VadSegments(silence, late_frames), outputMode="Append", timeMode="None",
        outputStructType="name STRING, start_idx BIGINT, end_idx BIGINT, rms DOUBLE, audio_s DOUBLE")
    keys = F.from_json("name", "array<string>")
    return out.select(*[keys[i].cast(parts.schema[k].dataType).alias(k) for i, k in enumerate(key)], "start_idx", "end_idx", "rms", "audio_s")


def stream_fixed_segments(
    parts: DataFrame, segment_s: int = dims.FIXED_SEGMENT_S, overlap_s: int = dims.FIXED_OVERLAP_S,
    key: list[str] = ["stream_id"], started: str = "started", late: str = "120 seconds",
) -> DataFrame:
    """Overlapping fixed segments of a stream of (partial) frames, in update mode: a row when a segment is complete.

    ``started`` tells when a stream began, which gives every segment an event time. A segment that is still
    not complete when the newest one of any stream began ``late`` after it is given up, and its state is dropped.
    """
    length, step = segment_s * 10, (segment_s - overlap_s) * 10
    idx = F.col("frame_idx")
    first = F.greatest(F.lit(0), F.floor((idx - length) / step) + 1).cast("bigint")
    spread = parts.select(*key, started, "n", "sumsq", F.explode(F.sequence(first, F.floor(idx / step).cast("bigint"))).alias("seg_no"))
    at = F.timestamp_micros(F.unix_micros(started) + F.col("seg_no") * (step * 100_000))
    per = spread.withColumn("_at", at).withWatermark("_at", late).groupBy(*key, "seg_no", "_at").agg(
        F.sum("n").alias("_n"), F.sum("sumsq").alias("_s"))
    start = F.col("seg_no") * step
    return per.filter(F.col("_n") == length * dims.FRAME_SAMPLES).select(
        *key, "seg_no", start.alias("start_idx"), (start + length - 1).alias("end_idx"), F.sqrt(F.col("_s") / F.col("_n")).alias("rms"))
