"""Texts of an Arrow batch as one numpy byte buffer, cut into pieces of bounded size.

All helpers work on whole texts. A piece holds as many rows as fit into ``PIECE`` bytes, or one
longer row, so the memory of a task does not depend on the rows per batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

try:  # blocks of 16 MB and more go back to the system when they are freed, instead of staying with the worker
    ctypes.CDLL(None).mallopt(-3, 1 << 24)
except (AttributeError, OSError):  # another C library
    pass

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base (``up``) or of its inverse modulo 2**64 (``down``)."""
    if len(_powers[kind]) < n:
        steps = np.full(max(n, PIECE + 64), BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    elif pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        kind = np.int32
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


class Piece:
    """Some rows' bytes, with prefix hashes on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._prefix: np.ndarray | None = None

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte strings ``[start, end)``; equal strings have equal hashes."""
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power("up", len(self.data)), out=self._prefix[1:])
        value = (self._prefix[ends] - self._prefix[starts]) * _power("down", len(self.data) + 1)[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def per_row(self, marks: np.ndarray) -> np.ndarray:
        """How many marked bytes each row has."""
        total = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(starts, ends, first)`` of ``[^\\x20\\x09-\\x0D]+``; first[r] is row r's first word, first[-1] their number."""
        n = len(self.data)
        inside = ~SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        starts = inside & edge[:n]
        starts[1:] |= inside[1:] & ~inside[:-1]
        ends = inside & edge[1:]
        ends[:-1] |= inside[:-1] & ~inside[1:]
        at = np.flatnonzero(starts)
        return at, np.flatnonzero(ends) + 1, np.searchsorted(at, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """``(starts, ends)`` of the lines between line feeds; each row has at least one."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        return starts, ends


def text_pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, Piece]]:
    data, offsets = buffers(texts)
    for a, b in pieces(offsets, limit):
        yield a, b, Piece(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    return np.isin(keys, np.unique(twice)) if len(twice) else np.zeros(len(keys), bool)
