"""Transcripts that hold reference texts kept for evaluation, whole but for a few edits.

The q-gram lemma: a reference of m code points that occurs with at most k edits shares at least
m - q + 1 - k * q of its q-grams with the place where it occurs, on diagonals that lie within k of each other. So
shared q-grams are counted in overlapping bands of diagonals, bands below that count are dropped without loss,
and the rest are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aetherlog.llm.chunks import BASE, buffers, mix, pieces
from aetherlog.llm.shared import stored

BLOCK_CHARS = 1 << 20  # code points of references that one pass over the transcripts takes along
_PIECE = 1 << 19
_GAP = np.uint32(0xFFFFFFFF)
_STEP = np.int64(1 << 24)  # one edit; below it the diagonal of the beginning
_FAR = np.int64(1 << 60)


def _points(raw: np.ndarray) -> np.ndarray:
    """Code points, Latin capitals in lower case, every white space a blank."""
    p = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    upper = (p >= 65) & (p <= 90) | (p >= 0xC0) & (p <= 0xDE) & (p != 0xD7)
    p[upper] += 32
    p[(p >= 9) & (p <= 13)] = 32
    return p


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    if len(points) < q:
        return np.zeros(0, np.uint64)
    code = np.zeros(len(points) - q + 1, np.uint64)
    for i in range(q):
        code = code * BASE + points[i:len(points) - q + 1 + i]
    return mix(code)


def gram_size(length: int) -> int:
    """q for a reference of this many code points: large where it is selective, small where the bound needs it."""
    return 8 if length >= 60 else 5


class References:
    """A bounded block of references with its q-gram index."""

    def __init__(self, ids: list, texts: list[str], edit_percent: int):
        self.ids = ids
        self.points = [_points(np.frombuffer(t.encode(), np.uint8)) for t in texts]
        self.size = np.array([len(p) for p in self.points], np.int64)
        self.edits = self.size * edit_percent // 100
        self.index = {}
        for q in sorted({gram_size(n) for n in self.size.tolist()}):
            own = [i for i, n in enumerate(self.size.tolist()) if gram_size(n) == q]
            grams = [_grams(self.points[i], q) for i in own]
            code = np.concatenate(grams)
            item = np.repeat(np.array(own), [len(g) for g in grams])
            place = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(code, kind="stable")
            keys, first = np.unique(code[order], return_index=True)
            bits = np.zeros(1 << 22, bool)
            bits[(keys >> np.uint64(42)).astype(np.int64)] = True
            self.index[q] = bits, keys, np.append(first, len(code)), item[order], place[order]
        q = np.array([gram_size(n) for n in self.size.tolist()])
        self.least = self.size - q + 1 - self.edits * q


def _candidates(points: np.ndarray, starts: np.ndarray, refs: References) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(item, row, diagonal)`` of the bands with enough shared q-grams; a band holds 2 * (edits + 1) diagonals."""
    longest = int(refs.size.max())
    apart = 3 * longest + 8  # rows lie so far apart that no band spans two
    found = []
    for q, (bits, keys, first, items, places) in refs.index.items():
        code = _grams(points, q)
        at = np.flatnonzero(bits[(code >> np.uint64(42)).astype(np.int64)])
        row = np.searchsorted(starts, at, "right") - 1
        inside = at + q <= starts[row + 1]
        at, row = at[inside], row[inside]
        k = np.minimum(np.searchsorted(keys, code[at]), len(keys) - 1)
        exact = keys[k] == code[at]
        at, row, k = at[exact], row[exact], k[exact]
        many = first[k + 1] - first[k]
        post = np.repeat(first[k] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        item = items[post]
        diagonal = np.repeat(at + row * apart, many) - places[post] + longest
        band = diagonal // (refs.edits[item] + 1)
        found.append(item << 44 | band)
        found.append(item << 44 | np.maximum(band - 1, 0))
    both = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    if not len(both):
        return (np.zeros(0, np.int64),) * 3
    heads = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    count = np.diff(np.append(heads, len(both)))
    item = both[heads] >> 44
    enough = count >= refs.least[item]
    key, item = both[heads][enough], item[enough]
    diagonal = (key & ((1 << 44) - 1)) * (refs.edits[item] + 1) - longest
    # the row that the middle of the place lies in
    shifted = starts[:-1] + np.arange(len(starts) - 1) * apart
    row = np.searchsorted(shifted - longest - 1, diagonal, "right") - 1
    return item, row, diagonal - row * apart


def _align(points: np.ndarray, starts: np.ndarray, item: np.ndarray, row: np.ndarray, diagonal: np.ndarray,
           refs: References) -> list[tuple[int, int, int, int, int]]:
    """Banded alignment of whole references with a part of the text; ``(row, item, start, stop, edits)`` within the budget."""
    out = []
    order = np.argsort(refs.size[item], kind="stable")
    for part in np.array_split(order, max(1, -(-len(order) // 256))):
        it, ro, di = item[part], row[part], diagonal[part]
        size, budget = refs.size[it], refs.edits[it]
        width, rounds = int(2 * (budget.max() + 1)), int(size.max())
        words = np.full((len(part), rounds), _GAP, np.uint32)
        for r, i in enumerate(it):
            words[r, :refs.size[i]] = refs.points[i]
        span = np.arange(width + rounds)
        place = di[:, None] + span
        within = (place >= starts[ro][:, None]) & (place < starts[ro + 1][:, None])
        text = np.where(within, points[np.clip(place, 0, max(len(points) - 1, 0))], _GAP - np.uint32(1))
        lanes = np.arange(width, dtype=np.int64)
        cost = np.broadcast_to(lanes, (len(part), width)).copy()
        cost[lanes[None, :] >= (2 * (budget + 1))[:, None]] = _FAR
        last = np.full((len(part), width), _FAR)
        for i in range(rounds):
            step = cost + np.where(words[:, i, None] == text[:, i:i + width], 0, _STEP)
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + _STEP)
            cost = np.minimum.accumulate(step - lanes * _STEP, axis=1) + lanes * _STEP
            done = size == i + 1
            last[done] = cost[done]
        lane = np.argmin(last, axis=1)
        best = last[np.arange(len(part)), lane]
        edits = best // _STEP
        for r in np.flatnonzero(edits <= budget):
            begin = max(int(di[r] + best[r] % _STEP), int(starts[ro[r]]))
            end = min(int(di[r] + lane[r] + size[r]), int(starts[ro[r] + 1]))
            out.append((int(ro[r]), int(it[r]), begin - int(starts[ro[r]]), end - int(starts[ro[r]]), int(edits[r])))
    return out


def _distinct(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of overlapping places of one reference in one text, that with the fewest edits, the first of equals."""
    kept: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = {}
    for m in sorted(set(found), key=lambda m: (m[4], m[2], m[3])):
        own = kept.setdefault(m[:2], [])
        if all(m[3] <= o[2] or m[2] >= o[3] for o in own):
            own.append(m)
    return sorted(m for own in kept.values() for m in own)


def find_references(texts: pa.Array, refs: References) -> list[tuple[int, int, int, int, int]]:
    """``(row, item, start, stop, edits)`` of every occurrence, in code points of the text."""
    data, offsets = buffers(texts)
    out = []
    for a, b in pieces(offsets, _PIECE):
        raw = data[offsets[a]:offsets[b]]
        if not len(raw):
            continue
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        starts = heads[offsets[a:b + 1] - offsets[a]]
        points = _points(raw)
        item, row, diagonal = _candidates(points, starts, refs)
        if len(item):
            out += [(r + a, *m) for r, *m in _distinct(_align(points, starts, item, row, diagonal, refs))]
    return out


def _pass(transcripts: DataFrame, key: str, text: str, refs: References, id_type: str) -> DataFrame:
    source = transcripts.select(F.col(key), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_references(batch.column(1), refs)
            rows, items, start, stop, edits = zip(*found) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(
                    pa.array(x, pa.int64()) for x in (items, start, stop, edits))], names=[key, "item", "start", "stop", "edits"])

    found = source.mapInArrow(run, f"`{key}` {source.dtypes[0][1]}, item BIGINT, start BIGINT, stop BIGINT, edits BIGINT")
    names = transcripts.sparkSession.createDataFrame([(i, x) for i, x in enumerate(refs.ids)], f"item BIGINT, reference_id {id_type}")
    return found.join(F.broadcast(names), "item").select(key, "reference_id", "start", "stop", "edits")  # names: one block's


def leaked_references(transcripts: DataFrame, references: DataFrame, key: str = "transcript_id", text: str = "text",
                      reference_key: str = "reference_id", reference_text: str = "text", edit_percent: int = 10,
                      min_chars: int = 16, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per occurrence of a reference in a transcript: key, reference_id, start, stop (code points), edits.

    An occurrence holds the whole reference with at most ``edit_percent`` percent of its code points inserted, deleted or
    replaced; Latin letters up to U+00FF match in either case, and white space matches white space. Whole texts are searched. References are read
    in blocks of ``block_chars`` code points, each in one pass over the transcripts, so neither the
    driver nor a task ever holds more. Null and empty transcripts hold nothing; references that are null or shorter than ``min_chars`` are
    not looked for, as they would mark ordinary talk. Repeated transcripts or references give repeated rows; empty tables no rows.
    """
    named = references.filter(F.length(reference_text) >= min_chars).select(reference_key, reference_text)
    id_type = named.dtypes[0][1]
    found, ids, texts, size = None, [], [], 0

    def flush(last: bool) -> None:
        nonlocal found, ids, texts, size
        if ids:
            block = _pass(transcripts, key, text, References(ids, texts, edit_percent), id_type)
            if not last or found is not None:
                block = stored(block, "leaked-references")
            found = block if found is None else found.unionByName(block)
        ids, texts, size = [], [], 0

    for row in named.toLocalIterator():
        if size and size + len(row[1]) > block_chars:
            flush(False)
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
    flush(True)
    if found is None:
        return transcripts.sparkSession.createDataFrame(
            [], f"`{key}` {transcripts.select(key).dtypes[0][1]}, reference_id {id_type}, start BIGINT, stop BIGINT, edits BIGINT")
    return found


def decontaminate(transcripts: DataFrame, references: DataFrame, key: str = "transcript_id", **options) -> DataFrame:
    """The transcripts without those in which a reference occurs, all columns as they are (see :func:`leaked_references`)."""
    found = leaked_references(transcripts, references, key, **options).select(F.col(key).alias("__leaked")).distinct()
    return transcripts.join(found, transcripts[key].eqNullSafe(F.col("__leaked")), "left_anti")
