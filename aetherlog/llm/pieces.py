"""Transcripts as ids of a SentencePiece vocabulary, and back.

A word is a space and what follows up to the next one; a text gets one space in front. Equally long words
advance together, position by position: substring hashes probe the sorted piece keys, and the best last piece of every prefix
is stored as a backpointer. In a ``unigram`` vocabulary the best one has the largest sum of scores. In a ``bpe``
vocabulary, whose scores are merge ranks and no log-probabilities, sums would give other ids than the library does; there the
best last piece is the one that merging by rank leaves next to the prefix's last piece, and exactly one is. Code points without
a piece become their UTF-8 bytes' pieces, so every text comes back exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aetherlog.llm.chunks import BASE, buffers, mix, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_BATCH = 1 << 20


@dataclass
class Vocabulary:
    """A model file's pieces as arrays: of fixed size, so tasks get it with their function."""

    keys: np.ndarray     # sorted hashes of the pieces
    ids: np.ndarray      # id of each key
    scores: np.ndarray   # score of each key
    longest: int         # code points of the longest piece
    byte_ids: np.ndarray  # id of each byte's piece
    unknown: float       # score of a code point without a piece
    data: np.ndarray     # all pieces' bytes by id, one after the other
    offsets: np.ndarray
    near: np.ndarray     # place of the first key with each 17 top bits or more
    steps: int           # most keys with the same top bits
    kind: str
    order: np.ndarray    # rank order of each id: single code points first, then merged pieces by rank
    left: np.ndarray     # the two parts, as orders, of the last merge that makes the piece of an order
    right: np.ndarray    # (of a single code point: itself)
    pairs: np.ndarray    # sorted left << 32 | right of all pairs of pieces that make a piece
    merged: np.ndarray   # order of the piece each pair makes
    runs: np.ndarray     # id of the piece of n spaces at n (-1: none)
    mark: int = 0        # of the merges: what a worker remembers of one vocabulary is not used for another

    def __post_init__(self) -> None:
        self.mark = zlib.crc32(self.merged.tobytes(), zlib.crc32(self.pairs.tobytes()))


def _merge_tables(rows: list[tuple[str, int, float]], n: int) -> tuple[np.ndarray, ...]:
    """Rank order, last merges and mergeable pairs of a vocabulary of merges."""
    ranked = sorted(rows, key=lambda r: (len(r[0]) > 1, -r[2]))
    rank = {text: k for k, (text, _, _) in enumerate(ranked)}
    order = np.full(n, -1, np.int64)
    left, right = np.arange(len(ranked)), np.arange(len(ranked))
    pairs = {}
    for k, (text, i, _) in enumerate(ranked):
        parts = list(text)
        while len(parts) > 1:
            made = [(rank.get(a + b, n), at) for at, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, at = min(made)
            if best == n:
                break
            if len(parts) == 2 and all(x in rank for x in parts):
                left[k], right[k] = rank[parts[0]], rank[parts[1]]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 1 and (len(text) == 1 or left[k] != k):  # else no merge ever makes it
            order[i] = k
        for cut in range(1, len(text)):
            a, b = rank.get(text[:cut]), rank.get(text[cut:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = k
    keys = np.array(sorted(pairs), np.int64)
    return order, left, right, keys, np.array([pairs[k] for k in keys.tolist()], np.int64)


def load_vocabulary(path: str = MODEL, kind: str = "bpe") -> Vocabulary:
    """Read pieces and scores on the driver; the model file is needed there only. kind: ``bpe`` or ``unigram``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    body, rows, byte_ids, runs = [b""] * n, [], np.full(256, model.unk_id(), np.int32), {}
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            body[i] = bytes([int(piece[1:-1], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            text = piece.replace(_SPACE, " ")
            body[i] = text.encode()
            if not text.strip(" "):
                runs[len(text)] = i
            if " " not in text[1:]:  # no piece spans two words
                rows.append((text, i, model.get_score(i)))
    points = np.frombuffer("".join(r[0] for r in rows).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(r[0]) for r in rows])
    keys = np.array([int(_prefixes(points[None, e - len(r[0]):e])[0, -1]) for r, e in zip(rows, ends)], np.uint64)
    keys = _key(keys, np.array([len(r[0]) for r in rows]))
    order = np.argsort(keys)
    top = (keys[order] >> np.uint64(47)).astype(np.int64)
    near = np.minimum(np.searchsorted(top, np.arange(1 << 17)), len(keys) - 1)
    scores = np.array([r[2] for r in rows])
    return Vocabulary(keys[order], np.array([r[1] for r in rows], np.int32)[order], scores[order], max(len(r[0]) for r in rows),
                      byte_ids, float(scores[scores > -1e8].min()) - 10.0, np.frombuffer(b"".join(body), np.uint8),
                      np.concatenate([[0], np.cumsum([len(b) for b in body])]), near,
                      int(np.bincount(top).max()), kind, *_merge_tables(rows, n),
                      np.array([runs.get(k, -1) for k in range(max(runs, default=1) + 1)]))


def _prefixes(points: np.ndarray) -> np.ndarray:
    """Prefix hashes of equally long words, one word per row."""
    n, length = points.shape
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length - 1, BASE)]), dtype=np.uint64)
    out = np.zeros((n, length + 1), np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, axis=1, out=out[:, 1:])
    return out


def _key(value: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    return mix(value + np.uint64(0xD6E8FEB86659FD93) * np.asarray(length).astype(np.uint64))


def probe(keys: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """Places of the keys in the sorted keys: from the first one with the same top bits onwards."""
    at = voc.near[(keys >> np.uint64(47)).astype(np.int64)]
    for _ in range(voc.steps):
        at = at + (voc.keys[at] < keys)
        np.minimum(at, len(voc.keys) - 1, out=at)
    return at


_SLOTS = 1 << 20
_seen: dict[int, np.ndarray] = {}  # the pairs met before, of one vocabulary


def remembered(first: np.ndarray, second: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """:func:`lasting` with a table of fixed size for the pairs of this vocabulary met before."""
    if voc.mark not in _seen:
        _seen.clear()
        _seen[voc.mark] = np.full(_SLOTS, -1, np.int64)
    table = _seen[voc.mark]
    key = first << 32 | second << 1
    slot = (mix(key.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
    held = table[slot]
    missing = np.flatnonzero((held ^ key) & ~1)
    if len(missing):
        pair = np.unique(key[missing])
        answer = pair | lasting(pair >> 32, (pair & 0xFFFFFFFF) >> 1, voc)
        held[missing] = answer[np.searchsorted(pair, key[missing])]
        table[slot[missing]] = held[missing]
    return (held & 1).astype(bool)


def lasting(first: np.ndarray, second: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """Which pairs of pieces (as orders) merging leaves side by side: no merge across their seam comes first.

    Undoes the last merges next to the seam, latest first, and looks whether the two parts that met
    there would have merged before.
    """
    good = np.ones(len(first), bool)
    live = np.arange(len(first))
    a, b = first.copy(), second.copy()
    limit = np.full(len(first), 1 << 40, np.int64)
    while len(live):
        key = a << 32 | b
        at = np.minimum(np.searchsorted(voc.pairs, key), len(voc.pairs) - 1)
        bad = (voc.pairs[at] == key) & (voc.merged[at] < limit)
        good[live[bad]] = False
        undo_a = (a > b) & (voc.right[a] != a) | (voc.left[b] == b)
        ended = bad | (voc.right[a] == a) & (voc.left[b] == b)
        limit = np.where(undo_a, a, b + 1)
        a, b = np.where(undo_a, voc.right[a], a), np.where(undo_a, b, voc.left[b])
        live, a, b, limit = live[~ended], a[~ended], b[~ended], limit[~ended]
    return good


def viterbi(points: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Best cuts of equally long words (a row of code points each), all words advancing together.

    Returns, for each position, the length of the best last piece that ends there and its id (-1: a code
    point without a piece). Of equal sums the longest last piece wins.
    """
    n, length = points.shape
    prefix = _prefixes(points)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, _INVERSE)]), dtype=np.uint64)
    best = np.zeros((n, length + 1))
    back = np.zeros((n, length + 1), np.int32)
    piece = np.full((n, length + 1), -1, np.int32)
    for end in range(1, length + 1):
        widths = np.arange(min(end, voc.longest), 0, -1)
        begins = end - widths
        keys = _key((prefix[:, end, None] - prefix[:, begins]) * down[begins], widths)
        at = probe(keys, voc)
        known = voc.keys[at] == keys
        if voc.kind == "unigram":
            score = best[:, begins] + np.where(known, voc.scores[at], -np.inf)
            score[:, -1] = np.where(known[:, -1], score[:, -1], best[:, end - 1] + voc.unknown)
        else:
            own, before = voc.order[voc.ids[at]], voc.order[piece[:, begins]]
            fits = known & (own >= 0)
            seam = fits & (begins > 0) & (piece[:, begins] >= 0)
            fits[seam] = remembered(before[seam], own[seam], voc)
            score = np.where(fits, 0.0, -np.inf)
            score[:, -1] = np.where(known[:, -1], score[:, -1], 0.0)
        pick = np.argmax(score, axis=1)
        row = np.arange(n)
        best[:, end] = score[row, pick]
        back[:, end] = widths[pick]
        piece[:, end] = np.where(known[row, pick], voc.ids[at[row, pick]], -1)
    return back, piece


def _utf8(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points, a row each, the last byte first, then -1."""
    p = points.astype(np.int64)
    size = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
    out = np.full((len(p), 4), -1, np.int64)
    for k in range(4):
        tail = 0x80 | (p >> (6 * k)) & 0x3F
        head = np.where(size == 1, p, (0xF00 >> size & 0xFF) | p >> (6 * k))
        out[:, k] = np.where(k < size - 1, tail, np.where(k == size - 1, head, -1))
    return out


def _encode_words(words: pa.Array, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words, one after the other, and the offsets of each word's ids."""
    raw, off = buffers(words)
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    start = heads[off]
    length = np.diff(start)
    steps_of: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, order in word, id
    for size in np.unique(length):
        members = np.flatnonzero(length == size)
        for m in np.array_split(members, max(1, len(members) * int(size) // 100_000)):
            points = chars[start[m][:, None] + np.arange(size)]
            back, piece = viterbi(points, voc)
            at, live, step = np.full(len(m), size), np.arange(len(m)), 0
            while len(live):
                here = at[live]
                found = piece[live, here]
                bare = found < 0
                steps_of.append((m[live[~bare]], np.full((~bare).sum(), step * 4, np.int64), found[~bare]))
                if bare.any():  # bytes, the last one first
                    coded = _utf8(points[live[bare], here[bare] - 1])
                    owner, nth = np.nonzero(coded >= 0)
                    steps_of.append((m[live[bare][owner]], step * 4 + nth, voc.byte_ids[coded[owner, nth]]))
                at[live] -= back[live, here]
                live = live[at[live] > 0]
                step += 1
    if not steps_of:
        return np.zeros(0, np.int32), np.zeros(len(length) + 1, np.int64)
    word, order, ids = (np.concatenate(x) for x in zip(*steps_of))
    place = np.lexsort((-order, word))
    counts = np.bincount(word, minlength=len(length))
    return ids[place].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


def _join_spaces(ids: np.ndarray, counts: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Runs of single spaces in a text as the pieces of many spaces, the longest first."""
    single = ids == voc.runs[1]
    inner = single[1:] & single[:-1]
    edges = np.cumsum(counts)[:-1]
    inner[edges[(edges > 0) & (edges < len(ids))] - 1] = False  # not across texts
    if not inner.any():
        return ids, counts
    step = np.diff(np.concatenate([[0], inner.astype(np.int8), [0]]))
    keep, out = np.ones(len(ids), bool), ids.copy()
    sizes = np.flatnonzero(voc.runs >= 0)
    for h, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1):
        while h < e:
            m = int(sizes[sizes <= e - h].max())
            out[h] = voc.runs[m]
            keep[h + 1:h + m] = False
            h += m
    row = np.repeat(np.arange(len(counts)), counts)
    return out[keep], np.bincount(row[keep], minlength=len(counts))


def _gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the slices ``flat[offsets[i]:offsets[i + 1]]`` for i in index; their ends."""
    size = offsets[index + 1] - offsets[index]
    ends = np.cumsum(size)
    shift = np.repeat(offsets[index] - (ends - size), size)
    return flat[np.arange(len(shift)) + shift], ends


def encode_array(texts: pa.Array, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and the offsets of each text's ids."""
    data, offsets = buffers(texts)
    flats, counts = [np.zeros(0, np.int32)], []
    for a, b in pieces(offsets, _BATCH):
        own = offsets[a:b + 1] - offsets[a]
        full = np.flatnonzero(np.diff(own) > 0)
        if not len(full):
            counts.append(np.zeros(b - a, np.int64))
            continue
        spaced = np.insert(data[offsets[a]:offsets[b]], own[full], 0x20)
        begin = own[full] + np.arange(len(full))
        cuts = np.flatnonzero(spaced == 0x20)
        word_offsets = np.append(cuts, len(spaced)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(word_offsets), pa.py_buffer(spaced.tobytes())])
        coded = words.dictionary_encode()
        ids, id_offsets = _encode_words(coded.dictionary, voc)
        flat, ends = _gather(ids, id_offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.concatenate([[0], ends])
        first = np.append(np.searchsorted(cuts, begin), len(cuts))
        count = np.zeros(b - a, np.int64)
        count[full] = np.diff(ends[first])
        if voc.kind == "bpe":
            flat, count = _join_spaces(flat, count, voc)
        flats.append(flat)
        counts.append(count)
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return np.concatenate(flats), np.concatenate([[0], np.cumsum(counts)])


def decode_flat(ids: np.ndarray, offsets: np.ndarray, voc: Vocabulary) -> pa.Array:
    """Texts of the id lists ``ids[offsets[i]:offsets[i + 1]]``; bytes that are no UTF-8 become U+FFFD."""
    flat, ends = _gather(voc.data, voc.offsets, ids.astype(np.int64))
    edges = np.concatenate([[0], ends])[offsets]
    body = flat.tobytes()
    return pa.array([body[max(s, 0):e][1 if body[s:s + 1] == b" " else 0:].decode("utf-8", "replace") for s, e in zip(edges, edges[1:])],
                    pa.string())


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _blocks(batch: pa.RecordBatch, column: int, limit: int = 4 * _BATCH) -> Iterator[pa.RecordBatch]:
    _, offsets = buffers(batch.column(column))
    for a, b in pieces(offsets, limit):
        yield batch.slice(a, b - a)


def encode(transcripts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("transcript_id",),
           model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """The columns in ``keep``, ids (array of int), n_ids and exact (decoding gives the text again).

    Works on whole texts, a bounded block at a time. A null text counts as an empty one: no ids, exact. A U+2581
    in a text is no space: it becomes bytes. Rows are taken one by one: repeated rows give repeated results, an empty table an empty one.
    """
    voc = load_vocabulary(model, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _blocks(whole, len(keep)):
                texts = batch.column(len(keep))
                ids, offsets = encode_array(texts, voc)
                again = decode_flat(ids, offsets, voc)
                exact = pa.compute.equal(again, texts.cast(pa.string()).fill_null(""))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(keep)], _lists(ids, offsets), pa.array(np.diff(offsets)), exact], names=[*keep, "ids", "n_ids", "exact"])

    source = transcripts.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join([*(f"`{c}` {t}" for c, t in source.dtypes[:-1]), "ids ARRAY<INT>, n_ids BIGINT, exact BOOLEAN"])
    return source.mapInArrow(run, fields)


def decode(encoded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("transcript_id",), model: str = MODEL) -> DataFrame:
    """The columns in ``keep`` and the text of each list of ids; a null list gives an empty text, an id out of range fails."""
    voc = load_vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep)).fill_null([])
            offsets = lists.offsets.to_numpy().astype(np.int64)
            texts = decode_flat(lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0], voc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], texts], names=[*keep, "text"])

    source = encoded.select(*keep, F.col(ids).cast("array<int>").alias("__ids"))
    fields = ", ".join([*(f"`{c}` {t}" for c, t in source.dtypes[:-1]), "text STRING"])
    return source.mapInArrow(run, fields)
