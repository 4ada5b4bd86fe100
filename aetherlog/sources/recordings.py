"""Recordings of any size as a data source: a file is read by many tasks, in batch and as it grows.

Each partition is a range of bytes that begins at a chunk, so no task needs what another one reads, and none holds more than a part
of its range at a time. The files are reached through ``pyarrow.fs``: local and shared folders, and the object stores it knows.
"""

from __future__ import annotations

import posixpath
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from aetherlog import dims

FORMAT = "pcm_recordings"
BLOCK_BYTES = 64 << 20
_READ_BYTES = 1 << 20
SCHEMA = "stream_id STRING, ts TIMESTAMP, seq BIGINT, pcm BINARY"


def _at(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path on it, and what to put before such a path to name a file from outside."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    system, inner = fs.FileSystem.from_uri(path)
    parts = urlsplit(path)
    return system, inner, f"{parts.scheme or 'file'}://"


@dataclass
class Span(InputPartition):
    """Bytes of a recording, from the beginning of a chunk on; ``end`` is where a chunk or the recording ends."""

    file: str
    name: str
    changed_us: int
    start: int
    end: int


@dataclass
class Spans(InputPartition):
    """Spans that one task reads one after the other."""

    spans: list[Span]


_TASKS = 512  # from so many on, short spans share a task


def _shared(spans: list[Span], block: int) -> list[Spans]:
    """Neighbouring spans together: no more tasks than ``_TASKS`` or so while a task stays below ``BLOCK_BYTES``."""
    most = max(block, min(sum(s.end - s.start for s in spans) // _TASKS, BLOCK_BYTES))
    out, size = [], 0
    for s in spans:
        if not out or size + s.end - s.start > most:
            out.append(Spans([]))
            size = 0
        out[-1].spans.append(s)
        size += s.end - s.start
    return out


def _spans(file: str, name: str, changed_us: int, start: int, end: int, chunk: int, block: int) -> list[Span]:
    start -= start % chunk
    block = max(block - block % chunk, chunk)
    return [Span(file, name, changed_us, a, min(a + block, end)) for a in range(start, end, block)]


class _Recordings:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.chunk = int(options.get("chunkbytes", dims.CHUNK_BYTES))
        self.block = int(options.get("blockbytes", BLOCK_BYTES))
        self.quiet = float(options.get("quietseconds", 60))
        self.most = int(options.get("maxbytespertrigger", 0))

    def files(self) -> list[tuple[str, str, int, int]]:
        """``(path, name, changed, bytes)`` of all recordings, in the order of their names."""
        system, inner, before = _at(self.path)
        info = system.get_file_info(inner)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
        return sorted((f.path, before + f.path, int(f.mtime_ns or 0) // 1000, f.size) for f in found
                      if f.type == fs.FileType.File and f.size and not posixpath.basename(f.path).startswith((".", "_")))

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        system, _, _ = _at(self.path)
        step = max(_READ_BYTES - _READ_BYTES % self.chunk, self.chunk)
        with system.open_input_file(span.file) as f:
            for at in range(span.start, span.end, step):
                f.seek(at)
                body = f.read(min(step, span.end - at))
                n = -(-len(body) // self.chunk)
                edges = np.minimum(np.arange(n + 1, dtype=np.int32) * self.chunk, len(body)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([span.name] * n), pa.array([span.changed_us] * n, pa.timestamp("us", "UTC")),
                     pa.array(np.arange(at // self.chunk, at // self.chunk + n)),
                     pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(body)])],
                    names=["stream_id", "ts", "seq", "pcm"])


class _BatchReader(_Recordings, DataSourceReader):
    def partitions(self) -> list[Spans]:
        spans = [s for file, name, changed, size in self.files() for s in _spans(file, name, changed, 0, size, self.chunk, self.block)]
        return _shared(spans, self.block) or [Spans([])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        for span in partition.spans:
            yield from _Recordings.read(self, span)


class _GrowingReader(_Recordings, DataSourceStreamReader):
    """Whole chunks as recordings grow; the short one at the end once nothing was added for ``quietSeconds``.

    The offset is one number for each file that is in the folder; recordings that are taken out of it are forgotten.
    """

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now, left = time.time(), self.most or 1 << 62
        told = getattr(self, "told", {})
        out = {}
        for file, _, changed, size in self.files():
            end = size if now - changed / 1e6 >= self.quiet else size - size % self.chunk
            begun = min(told.get(file, 0), end)
            room = left - left % self.chunk
            out[file] = end if end - begun <= left else begun - begun % self.chunk + room
            left = max(left - (out[file] - begun), 0)
        self.told = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.told = dict(end)
        known = {file: (name, changed) for file, name, changed, _ in self.files()}
        return [s for file, stop in sorted(end.items()) if file in known and stop > start.get(file, 0)
                for s in _spans(file, *known[file], start.get(file, 0), stop, self.chunk, self.block)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from _Recordings.read(self, partition)

    def commit(self, end: dict) -> None:
        pass


class PcmRecordings(DataSource):
    """``spark.read.format("pcm_recordings")`` and ``readStream``: chunks of raw recordings, one file a stream.

    Options: ``path``, ``chunkBytes``, ``blockBytes`` (of one task), and for streams ``quietSeconds`` and ``maxBytesPerTrigger``.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _plain(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self._plain())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _GrowingReader(self._plain())


def write_recordings(recordings: DataFrame, path: str, name: str = "stream_id", content: str = "content", suffix: str = ".raw") -> None:
    """Write each row's bytes as one file ``<name>.raw``. A task that is tried again replaces its files."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner, _ = _at(path)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                draft = posixpath.join(inner, f"_{key}.{time.monotonic_ns()}")
                with system.open_output_stream(draft) as f:
                    f.write(body.as_buffer() or b"")
                system.move(draft, posixpath.join(inner, f"{key}{suffix}"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = recordings.filter(F.col(name).isNotNull()).select(F.col(name).cast("string"), content)
    rows.mapInArrow(put, "n BIGINT").agg(F.sum("n")).collect()
