"""Web archives of captures as seekable Zstandard bundles.

An archive is a row with the bytes of one ``.warc.zst`` file: frames that decompress on their own, each with
some records, and behind them a seek table in a skippable frame. An index maps every record identifier to its frame and
to its offset in the frame, so that one record is read by decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aetherlog.llm.shared import stored

FRAME_BYTES = 1 << 20     # records of one frame, uncompressed
ARCHIVE_BYTES = 16 << 20  # of one archive, uncompressed
# fixed values of the formats
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:capture:"
_INDEX = "ARRAY<STRUCT<record_id: STRING, frame: INT, offset: BIGINT, length: BIGINT>>"
_URI = "".join(map(chr, range(33, 127)))  # everything else in a url is percent-encoded
_UNDATED = "1970-01-01T00:00:00Z"


def record_types(captures: DataFrame, key: str = "capture_id", payload: str = "payload", min_bytes: int = 0) -> DataFrame:
    """key, payload_bytes, payload_sha1 (hex), refers_to: of equal payloads of ``min_bytes`` or more, the smallest key.

    ``refers_to`` is null for a response: the smallest key itself, a shorter payload, or payloads without any key.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    digests = captures.select(key, F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha1(body).alias("payload_sha1"))
    digests = stored(digests, "warc-digests")
    firsts = digests.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_bytes", "payload_sha1").agg(F.min(key).alias("first"))
    return digests.join(firsts, ["payload_bytes", "payload_sha1"], "left").select(
        key, "payload_bytes", "payload_sha1", F.when(F.col(key) != F.col("first"), F.col("first")).alias("refers_to"))


def _record(record_id: str, url: str | None, date: str, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{record_id}>",
             f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=_URI))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Collects records into frames and frames into an archive with a seek table."""

    def __init__(self, level: int, frame_bytes: int = FRAME_BYTES):
        self.compressor, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.offset = self.total = 0

    def add(self, record_id: str, record: bytes) -> None:
        if self.open and self.offset + len(record) > self.frame_bytes:
            self._close_frame()
        self.index.append((record_id, len(self.frames), self.offset, len(record)))
        self.open.append(record)
        self.offset += len(record)
        self.total += len(record)

    def _close_frame(self) -> None:
        raw = b"".join(self.open)
        self.frames.append(self.compressor.compress(raw))
        self.sizes.append((len(self.frames[-1]), len(raw)))
        self.open, self.offset = [], 0

    def finish(self) -> bytes:
        if self.open:
            self._close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = entries + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(footer)) + footer


def write_archives(captures: DataFrame, key: str = "capture_id", url: str = "stream_url", payload: str = "payload",
                   date: str | None = None, min_bytes: int = 0, level: int = 3, archive_bytes: int = ARCHIVE_BYTES,
                   frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per archive: archive (name), content (its bytes), records (the index entries).

    Every capture becomes a record: a revisit if a capture with a smaller key has the same payload of at least ``min_bytes`` bytes, else a
    response. Payloads are text or bytes; null counts as empty. ``date`` names a column of WARC dates (null or none: the epoch). A null
    url leaves out its header; blanks, control and other than ASCII characters in it are percent-encoded. Rows with a repeated key become a record each. An empty table gives no archive.
    The result is written to the shared folder and read back.
    """
    types = record_types(captures, key, payload, min_bytes).select(
        F.col(key).alias("__key"), F.col("payload_bytes").alias("__n"), F.unhex("payload_sha1").alias("__sha1"), F.col("refers_to").alias("__to"))
    types = types.dropDuplicates(["__key", "__n", "__sha1"])
    body = captures.select(
        F.col(key).cast("string").alias("id"), F.col(key).alias("__own"), F.col(url).cast("string").alias("url"),
        (F.col(date).cast("string") if date else F.lit(None).cast("string")).alias("date"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = body.join(types, F.col("__own").eqNullSafe(F.col("__key")) & (F.octet_length("payload") == F.col("__n"))
                     & (F.sha1("payload") == F.lower(F.hex("__sha1")))).select(
        "id", "url", "date", F.when(F.col("__to").isNull(), F.col("payload")).alias("payload"), "__n", "__sha1",
        F.col("__to").cast("string").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(level, frame_bytes)

        def finish() -> pa.RecordBatch:
            content = writer.finish()
            name = hashlib.sha1(content).hexdigest() + ".warc.zst"
            entries = [[{"record_id": i, "frame": f, "offset": o, "length": n} for i, f, o, n in writer.index]]
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array(entries, kind)],
                                              names=["archive", "content", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                record_id, target, day, content, size, sha1, to = (c[i].as_py() for c in batch.columns)
                name = quote(record_id, safe="") if record_id is not None else ""
                digest = base64.b32encode(sha1).decode()
                writer.add(name, _record(name, target, day or _UNDATED, content or b"", size, digest, quote(to, safe="") if to is not None else None))
                if writer.total >= archive_bytes:
                    yield finish()
                    writer = ArchiveWriter(level, frame_bytes)
        if writer.index:
            yield finish()

    return stored(rows.mapInArrow(write, f"archive STRING, content BINARY, records {_INDEX}"), "warc-archives")


def archive_index(archives: DataFrame) -> DataFrame:
    """record_id, archive, frame, offset and length (in the frame) of every record."""
    return archives.select("archive", F.explode("records").alias("r")).select("r.record_id", "archive", "r.frame", "r.offset", "r.length")


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """``(start, compressed, uncompressed)`` of every frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    begin, start, out = len(content) - 9 - n * width, 0, []
    for i in range(n):
        packed, raw = struct.unpack_from("<II", content, begin + i * width)
        out.append((start, packed, raw))
        start += packed
    return out


def read_frame(content: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, raw = frame
    return zstandard.ZstdDecompressor().decompress(content[start:start + packed], max_output_size=raw)


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """``(headers, block, end)`` of the record that begins at a position."""
    head = raw.index(b"\r\n\r\n", at)
    lines = raw[at:head].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record here")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    end = head + 4 + int(headers["Content-Length"])
    return headers, raw[head + 4:end], end + 4


def _result(headers: dict[str, str], block: bytes, payload: bool) -> tuple:
    http, _, body = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (len(body) != length or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError("damaged payload of " + headers["WARC-Record-ID"])
    own, to = (unquote(headers[h][1:-1].removeprefix(_URN)) if h in headers else None for h in ("WARC-Record-ID", "WARC-Refers-To"))
    target = headers.get("WARC-Target-URI")
    return own or None, target, headers["WARC-Type"], to, length, digest, body if payload and not revisit else None


_FIELDS = ("record_id STRING, target_uri STRING, record_type STRING, refers_to STRING, payload_bytes BIGINT, "
           "payload_digest STRING, payload BINARY")
_TYPES = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)],
                                      names=[f.split(" ")[0] for f in _FIELDS.split(", ")])


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Every record: record_id, target_uri, record_type, refers_to, payload_bytes, payload_digest, payload.

    Reads frame after frame by the seek table and checks each response against its digest: a damaged record fails. Size and
    digest are those of the full payload; the payload itself is null for revisits, and for all if not asked for.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                for frame in seek_table(data):
                    raw, at, rows = read_frame(data, frame), 0, []
                    while at < len(raw):
                        headers, block, at = parse_record(raw, at)
                        rows.append(_result(headers, block, payload))
                    yield _table(rows)

    return archives.select("content").mapInArrow(read, _FIELDS)


def fetch_records(archives: DataFrame, wanted: DataFrame, record_id: str = "record_id") -> DataFrame:
    """The wanted records only: their frames are found by the index, nothing else is decompressed."""
    places = archive_index(archives).join(wanted.select(F.col(record_id).cast("string").alias("record_id")).distinct(), "record_id", "left_semi")
    places = places.groupBy("archive").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))  # at most an archive's records

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, found in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                table, frames, rows = seek_table(data), {}, []
                for p in found.as_py():
                    if p["frame"] not in frames:
                        frames = {p["frame"]: read_frame(data, table[p["frame"]])}
                    headers, block, _ = parse_record(frames[p["frame"]], p["offset"])
                    rows.append(_result(headers, block, True))
                yield _table(rows)

    return archives.join(places, "archive").select("content", F.array_sort("places").alias("places")).mapInArrow(read, _FIELDS)


def reference_sql() -> str:
    """The types, sizes and digests of a write and read of ``pages`` from SQL alone."""
    digits = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex40, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * k}) & 31)::INT, 1)"
        for g in range(8) for k in range(4))
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex40 FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex40, payload_bytes) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {digits} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""
