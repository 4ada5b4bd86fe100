"""Two tokenizers aligned on transcripts: common token ends cut groups, overlaps link ids.

The ends of both token sequences are ascending offsets into the same bytes. The shorter list drives a galloping search in
the longer one: steps double until the offset is passed, then the last step is halved. Offsets that both lists hold cut the tokens into
groups; the ranks found for a token's start and end give the range of tokens of the other side that it overlaps.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import secrets
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aetherlog.llm.chunks import buffers, pieces
from aetherlog.llm.shared import stored

FOLDER = "/opt/tokenizers"
BYTE_BPE = f"{FOLDER}/byte_bpe_50k.json"
PIECE_BPE = f"{FOLDER}/piece_bpe_32k.model"
WINDOW = 1 << 18  # code points of a long text after which it is cut at the next place that neither tokenizer joins
PIECE = 1 << 21  # code points whose words are encoded together
BLOCK = 1 << 20  # links of one text after which equal ones are counted together
BLOCK_PAIRS = 1 << 16  # distinct id pairs after which a block of transcripts is closed,
BLOCK_BYTES = 1 << 23  # or bytes of its transcripts' pairs
_STRIDE = 32
_SEAM = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_WORD = re.compile(r"[!-~\w](?:.*[!-~\w])?\Z", re.S)
_TOGETHER = 1000  # words
_SPACE = "▁"


# --- the two tokenizers --------------------------------------------------------------------

# fixed value: how byte-level BPE of this kind splits a text before merging
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass
class Tokenizers:
    """Encoders of a byte-level (A) and a piece vocabulary (B), and every id's bytes."""

    encode_a: Callable[[list[str]], list[list[int]]]
    encode_b: Callable[[list[str]], list[list[int]]]
    a_bytes: tuple[np.ndarray, np.ndarray] = field(repr=False)
    b_bytes: tuple[np.ndarray, np.ndarray] = field(repr=False)

    @property
    def sizes(self) -> tuple[int, int]:
        return len(self.a_bytes[1]) - 1, len(self.b_bytes[1]) - 1


def _flat(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load(byte_level: bytes, piece_model: bytes) -> Tokenizers:
    """Both encoders from their files' content. Special tokens' strings inside texts are plain text.

    A vocabulary whose ids follow the order of its merges is run by ``tiktoken``, which gives the same ids in a quarter of the
    time; any other byte-level one by ``tokenizers``.
    """
    import sentencepiece

    said = json.loads(byte_level)
    alphabet, special = _byte_alphabet(), {t["content"]: t["id"] for t in said["added_tokens"]}
    vocabulary = {t: i for t, i in said["model"]["vocab"].items() if t not in special}
    made = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in said["model"]["merges"]]
    ranked = all(x < y for x, y in zip([255, *made], made)) and said["pre_tokenizer"] == {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not said["normalizer"]
    body = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
    for token, i in vocabulary.items():
        body[i] = bytes(alphabet[ch] for ch in token)
    for token, i in special.items():
        body[i] = token.encode()
    if ranked:
        import tiktoken

        ranks = {body[i]: i for i in vocabulary.values()}
        one = tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def encode_a(texts: list[str]) -> list[list[int]]:
            return [one(t) for t in texts]
    else:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        model = Tokenizer.from_buffer(byte_level)
        model.encode_special_tokens = True

        def encode_a(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
    other = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace(_SPACE, " ").encode()
             for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
    return Tokenizers(encode_a, lambda texts: b.encode(texts, num_threads=1), _flat(body), _flat(other))


def joined(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, ends)`` of a sequence of ids."""
    body, at = table
    size = at[ids + 1] - at[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return body[np.repeat(at[ids] - (ends - size), size) + np.arange(total)], ends


def windows(text: str) -> list[str]:
    """The text in parts of about ``WINDOW`` code points, cut in front of a single space between words.

    There no token of either side crosses, and both begin a new one: the byte-level one splits in front of such a space, and no
    piece has a space behind another character.
    """
    if len(text) <= WINDOW:
        return [text]
    out, at = [], 0
    while at < len(text):
        seam = _SEAM.search(text, at + WINDOW) if at + WINDOW < len(text) else None
        stop = seam.start() if seam else len(text)
        out.append(text[at:stop])
        at = stop
    return out


# --- alignment -----------------------------------------------------------------------------

def gallop(wanted: np.ndarray, held: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each wanted offset the rank of the first held one in ``[first, last)`` that is not smaller, else ``last``.

    All searches advance together: a step of 1, 2, 4 .. until it is passed, then the last step is halved.
    """
    low, step = first.copy(), np.ones(len(wanted), np.int64)
    live = np.flatnonzero(low < last)
    high = last.copy()
    while len(live):  # held[low - 1] is smaller than wanted, as far as there is one
        probe = np.minimum(low[live] + step[live], last[live]) - 1
        small = held[probe] < wanted[live]
        high[live[~small]] = probe[~small]
        low[live[small]] = probe[small] + 1
        step[live] *= 2
        live = live[small]
        live = live[low[live] < last[live]]
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        small = held[middle] < wanted[live]
        low[live[small]] = middle[small] + 1
        high[live[~small]] = middle[~small]
        live = live[low[live] < high[live]]
    return low


@dataclass
class Aligned:
    """Groups and links of some windows. ``closes_*`` marks tokens that end a group; links are pairs of token places."""

    closes_a: np.ndarray
    closes_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> Aligned:
    """Align the windows' tokens: ``ends_*`` ascend over all windows, window w has the tokens ``first_*[w]`` to ``first_*[w + 1]``.

    In each window the side with fewer tokens drives the search.
    """
    closes = [np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)]
    links: list[list[np.ndarray]] = [[], []]
    fewer = np.diff(first_a) <= np.diff(first_b)
    for side, chosen in ((0, fewer), (1, ~fewer)):
        near, far, first, other = (ends_a, ends_b, first_a, first_b) if side == 0 else (ends_b, ends_a, first_b, first_a)
        size = np.where(chosen, np.diff(first), 0)
        n = int(size.sum())
        if not n:
            continue
        window = np.repeat(np.arange(len(size)), size)
        token = np.arange(n) - np.repeat(np.cumsum(size) - size, size) + first[:-1][window]
        low, high = other[:-1][window], other[1:][window]
        lead = (token - first[:-1][window]) % _STRIDE == 0  # these search from the window's start, those after them go on from there
        low[:] = gallop(near[token[lead]], far, low[lead], high[lead])[np.cumsum(lead) - 1]
        rank = gallop(near[token], far, low, high)
        held = np.minimum(rank, len(far) - 1)
        common = (rank < other[1:][window]) & (far[held] == near[token])
        closes[side][token[common]] = True
        closes[1 - side][rank[common]] = True
        begins = np.empty(n, np.int64)  # the rank after the end of the token before, which is this token's start
        begins[1:] = (rank + common)[:-1]
        opens = token == first[:-1][window]
        begins[opens] = other[:-1][window[opens]]
        count = rank - begins + 1
        mine = np.repeat(token, count)
        theirs = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins, count)
        links[side].append(mine)
        links[1 - side].append(theirs)
    none = np.zeros(0, np.int64)
    return Aligned(*closes, np.concatenate([none, *links[0]]), np.concatenate([none, *links[1]]))


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0 .. n - 1, one row each, zero bytes in front."""
    width = len(str(max(n - 1, 0)))
    ids = np.arange(n)
    out = np.zeros((n, width), np.uint8)
    for k in range(width):
        power = 10 ** k
        out[:, width - 1 - k] = np.where((ids >= power) | (k == 0), ids // power % 10 + 48, 0)
    return out


def group_text(a: np.ndarray, b: np.ndarray, found: Aligned, first_a: np.ndarray, first_b: np.ndarray, digits: np.ndarray) -> list[bytes]:
    """For each window the ids of its groups as ``a1,a2|b1;a3|b2,b3``."""
    group_a = np.cumsum(found.closes_a) - found.closes_a  # groups are numbered over all windows; each has tokens of both
    group_b = np.cumsum(found.closes_b) - found.closes_b
    n = len(a) + len(b)
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    width = digits.shape[1]
    out = np.zeros((n, width + 1), np.uint8)
    out[place_a, :width], out[place_b, :width] = digits[a], digits[b]
    out[place_a, width] = np.where(found.closes_a, ord("|"), ord(","))
    out[place_b, width] = np.where(found.closes_b, ord(";"), ord(","))
    shown = out != 0
    size = np.concatenate([[0], np.cumsum(shown.sum(axis=1))])
    text, edges = out[shown], size[first_a + first_b]
    return [text[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:])]


# --- transcripts ---------------------------------------------------------------------------

def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and how often they occur."""
    pairs, times = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]) for k in (0, 1))
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    at = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[at], np.add.reduceat(times, at) if len(at) else times


@dataclass
class TextLinks:
    """What a text's windows have in common: counts of tokens (A, B), groups and links, the groups' digest, and its id pairs."""

    row: int
    exact: bool = True
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    digest: object = field(default_factory=hashlib.sha256)
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    pending: int = 0

    def add(self, exact: bool, spoken: Iterable[bytes], counts: list[int], pairs: np.ndarray, times: np.ndarray) -> None:
        """The next part of the text; ``spoken`` has the groups of its words."""
        self.exact = self.exact and exact
        if not self.exact:
            self.counts, self.pairs, self.pending = [0, 0, 0, 0], [], 0
            return
        if self.counts[0]:
            self.digest.update(b";")
        self.digest.update(b";".join(spoken))
        self.counts = [x + y for x, y in zip(self.counts, counts)]
        self.pairs.append((pairs, times))
        self.pending += len(pairs)
        if self.pending > BLOCK:
            self.pairs, self.pending = [_counted(self.pairs)], 0


@dataclass
class Words:
    """Words aligned once each: their counts of tokens (A, B), groups and links, and the id pairs of their links."""

    exact: np.ndarray
    counts: np.ndarray
    spoken: list[bytes]
    pairs: np.ndarray
    first: np.ndarray  # where each word's pairs begin
    place: np.ndarray  # where the words asked for stand here

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of the words with these numbers, and how often each stands there."""
        word, n = np.unique(numbers, return_counts=True)
        size = self.first[word + 1] - self.first[word]
        at = np.repeat(self.first[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.pairs[at], np.repeat(n, size)


def align_words(words: list[str], t: Tokenizers, digits: np.ndarray) -> Words:
    """Encode each word with a space in front by both tokenizers and align them; all words in one search.

    Words that begin and end like words are encoded many at a time, joined by the spaces that no token crosses.
    """
    whole = [i for i, w in enumerate(words) if _WORD.match(w)]
    odd = sorted(set(range(len(words))).difference(whole))
    place = np.empty(len(words), np.int64)
    place[whole + odd] = np.arange(len(words))
    words = [words[i] for i in whole + odd]
    parts = [" ".join(words[i:min(i + _TOGETHER, len(whole))]) for i in range(0, len(whole), _TOGETHER)] + words[len(whole):]
    said = [b" " + w.encode() for w in words]
    ids_a, ids_b = t.encode_a([" " + w for w in parts]), t.encode_b(parts)
    a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
    (body_a, ends_a), (body_b, ends_b) = joined(a, t.a_bytes), joined(b, t.b_bytes)
    edge = np.concatenate([[0], np.cumsum([len(s) for s in said])])
    body = b"".join(said)
    if body_a.tobytes() != body or body_b.tobytes() != body:  # some word does not come back: look at each
        ids_a, ids_b = t.encode_a([" " + w for w in words]), t.encode_b(words)
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        (body_a, ends_a), (body_b, ends_b) = joined(a, t.a_bytes), joined(b, t.b_bytes)
        first_a, first_b = (np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64) for ids in (ids_a, ids_b))
    else:
        first_a, first_b = (np.concatenate([[0], np.searchsorted(ends, edge[1:], "right")]) for ends in (ends_a, ends_b))
    cut_a, cut_b = (np.concatenate([[0], ends])[first] for ends, first in ((ends_a, first_a), (ends_b, first_b)))
    if body_a.tobytes() == body_b.tobytes() == body and (cut_a == edge).all() and (cut_b == edge).all():
        exact = np.ones(len(words), bool)
    else:
        exact = np.array([body_a[cut_a[w]:cut_a[w + 1]].tobytes() == s and body_b[cut_b[w]:cut_b[w + 1]].tobytes() == s for w, s in enumerate(said)])
    # words that do not come back are left out, so that both sides of all others end together
    keep_a, keep_b = (np.repeat(exact, np.diff(first)) for first in (first_a, first_b))
    ends_a = (ends_a - np.repeat(cut_a[:-1] - edge[:-1], np.diff(first_a)))[keep_a]
    ends_b = (ends_b - np.repeat(cut_b[:-1] - edge[:-1], np.diff(first_b)))[keep_b]
    a, b = a[keep_a], b[keep_b]
    first_a, first_b = (np.concatenate([[0], np.cumsum(np.where(exact, np.diff(first), 0))]) for first in (first_a, first_b))
    found = align(ends_a, ends_b, first_a, first_b)
    spoken = [x[:-1] for x in group_text(a, b, found, first_a, first_b, digits)]
    groups = np.concatenate([[0], np.cumsum(found.closes_a)])[first_a]
    order = np.argsort(found.link_a, kind="stable")
    pairs = (a[found.link_a] * t.sizes[1] + b[found.link_b])[order]
    links = np.searchsorted(found.link_a[order], first_a)
    return Words(exact, np.stack([np.diff(x) for x in (first_a, first_b, groups, links)], axis=1), spoken, pairs, links, place)


def align_texts(texts: list[str | None], t: Tokenizers, digits: np.ndarray) -> Iterator[TextLinks]:
    """Each text that has tokens, in order. A text that either side does not give back byte for byte comes with ``exact`` false.

    Texts are cut at all places that no token crosses, and words that occur again in a part of the texts are aligned once.
    """
    now: TextLinks | None = None
    known: dict[str, int] = {}
    held: list[tuple[int, np.ndarray]] = []

    def work() -> Iterator[TextLinks]:
        nonlocal now
        words = align_words(list(known), t, digits)
        for row, numbers in held:
            if now is None or now.row != row:
                if now is not None:
                    yield now
                now = TextLinks(row)
            numbers = words.place[numbers]
            now.add(bool(words.exact[numbers].all()), (words.spoken[i] for i in numbers.tolist()), words.counts[numbers].sum(axis=0).tolist(),
                    *words.of(numbers))
        known.clear()
        held.clear()

    size = 0
    for row, text in enumerate(texts):
        for w in windows(" " + text) if text else ():
            if held and size + len(w) > PIECE:
                yield from work()
                size = 0
            held.append((row, np.array([known.setdefault(x, len(known)) for x in _SEAM.split(w[1:])])))
            size += len(w)
    if held:
        yield from work()
    if now is not None:
        yield now


class _Block:
    """Distinct id pairs of some transcripts, numbered in the order they come in."""

    def __init__(self) -> None:
        self.name, self.size = secrets.randbits(62), 0
        self.pairs, self.number, self.times = [np.zeros(0, np.int64)] * 3

    def take(self, pairs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The pairs' numbers; unknown ones get the next numbers."""
        at = np.searchsorted(self.pairs, pairs)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == pairs[known]
        self.times[at[known]] += times[known]
        new = pairs[~known]
        fresh = np.arange(len(self.number), len(self.number) + len(new))
        out = np.empty(len(pairs), np.int64)
        out[known], out[~known] = self.number[at[known]], fresh
        self.pairs, self.number, self.times = (np.insert(x, at[~known], y) for x, y in ((self.pairs, new), (self.number, fresh), (self.times, times[~known])))
        return out


def _packed(numbers: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending numbers and counts in the narrowest kinds that hold them."""
    order = np.argsort(numbers)

    def narrow(x: np.ndarray) -> bytes:
        top = int(x.max(initial=0))
        kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
        return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()
    return narrow(numbers[order]), narrow(times[order])


def _unpacked(body: bytes) -> np.ndarray:
    return np.frombuffer(body, f"<u{body[0]}", offset=1).astype(np.int64)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_FIELDS = ", ".join(f"{c} BIGINT" for c in _COUNTS) + ", groups_sha256 STRING"


def aligned(transcripts: DataFrame, key: str, text: str, byte_level: str, piece_model: str) -> DataFrame:
    """A row per transcript with its counts and its pairs as numbers in its block; and rows ``(block, pair, number, times)`` of each block.

    Transcripts without tokens have no block.
    """
    with open(byte_level, "rb") as f, open(piece_model, "rb") as g:
        files = f.read(), g.read()  # two files of fixed size, sent with the tasks
    source = transcripts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, block = load(*files), _Block()
        digits = _digits(max(t.sizes))
        names = ["block", "key", *_COUNTS, "groups_sha256", "numbers", "times", "pair", "number", "n"]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block
            for at in range(0, len(block.pairs), 1 << 16):
                part = slice(at, at + (1 << 16))
                n = len(block.pairs[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.name] * n, pa.int64()), pa.nulls(n, of), *[pa.nulls(n, k) for k in kinds],
                     pa.array(block.pairs[part]), pa.array(block.number[part].astype(np.int32)), pa.array(block.times[part])], names=names)
            block = _Block()

        of = None
        for batch in batches:
            of = batch.column(0).type
            _, offsets = buffers(batch.column(1))
            for first, last in pieces(offsets, 1 << 22):
                n = last - first
                rows: list[tuple] = [(None, 0, 0, 0, 0, "", None, None)] * n
                for o in align_texts(batch.column(1).slice(first, n).to_pylist(), t, digits):
                    if o.exact:
                        pairs, times = _counted(o.pairs)
                        packed = _packed(block.take(pairs, times), times)
                        block.size += sum(map(len, packed))
                        rows[o.row] = (block.name, *o.counts, o.digest.hexdigest(), *packed)
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), batch.column(0).slice(first, n), *[pa.array(c, k) for c, k in zip(columns[1:], kinds)],
                     pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=names)
                if len(block.pairs) >= BLOCK_PAIRS or block.size >= BLOCK_BYTES:
                    yield from close()
        if of is not None:
            yield from close()

    return source.mapInArrow(run, f"block BIGINT, key {kind}, {_FIELDS}, numbers BINARY, times BINARY, pair BIGINT, number INT, n BIGINT")


def token_links(transcripts: DataFrame, key: str = "transcript_id", text: str = "text", byte_level: str = BYTE_BPE,
                piece_model: str = PIECE_BPE) -> DataFrame:
    """Align two tokenizers on every whole transcript, and weigh its links by how often their id pairs are linked in all transcripts.

    Returns key, n_a and n_b (tokens of the byte-level and of the piece tokenizer), n_groups (parts between common token ends),
    n_links (pairs of tokens that overlap), n_best (links whose pair is the most frequent one of its piece id, ties included),
    count_sum (the pairs' counts added up over the links) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``, the ids of the groups in order).
    The byte-level side reads a space and the text, the piece side the text, in front of which it puts the space itself. A text
    that is null, empty or not given back byte for byte by both has zeros and an empty digest. Repeated rows count as often as
    they come; an empty table gives an empty one. Texts of any length are worked off in windows that no token crosses.

    Pairs are first counted in blocks of transcripts; blocks, not transcripts, send their distinct pairs to the corpus-wide
    counts and get them back, so the shuffle holds each pair once a block.
    """
    with open(piece_model, "rb") as f:
        import sentencepiece

        pieces_known = sentencepiece.SentencePieceProcessor(model_proto=f.read()).get_piece_size()
    rows = stored(aligned(transcripts, key, text, byte_level, piece_model), "token-links")
    held = rows.filter(F.col("pair").isNotNull()).select("block", "pair", "number", "n")
    totals = held.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("piece", F.col("pair") % pieces_known)
    most = totals.groupBy("piece").agg(F.max("total").alias("most"))  # one row a piece id
    weighed = totals.join(most, "piece").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    known = held.select("block", "pair", "number").join(weighed, "pair").select(F.col("block").alias("of"), "number", "total", "best")
    said = rows.filter(F.col("pair").isNull())
    fields = ["key", *_COUNTS, "groups_sha256"]
    linked = said.filter(F.col("block").isNotNull()).select("block", *fields, "numbers", "times")
    kind = rows.schema["key"].dataType.simpleString()

    def weigh(texts: pa.Table, block: pa.Table) -> pa.Table:
        number = block.column("number").to_numpy()
        total, best = np.zeros(len(number), np.int64), np.zeros(len(number), bool)
        total[number], best[number] = block.column("total").to_numpy(), block.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for numbers, times in zip(texts.column("numbers"), texts.column("times")):
            at, n = _unpacked(numbers.as_py()), _unpacked(times.as_py())
            n_best.append(int(n[best[at]].sum()))
            count_sum.append(int((n * total[at]).sum()))
        return pa.table([*[texts.column(c) for c in fields], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())],
                        names=[*fields, "n_best", "count_sum"])

    out = linked.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        weigh, f"key {kind}, {_FIELDS}, n_best BIGINT, count_sum BIGINT")
    none = said.filter(F.col("block").isNull()).select(
        *fields, F.lit(0).cast("bigint").alias("n_best"), F.lit(0).cast("bigint").alias("count_sum"))
    return out.unionByName(none).select(F.col("key").alias(key), *_COUNTS, "n_best", "count_sum", "groups_sha256")
