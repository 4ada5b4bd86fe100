"""Byte strings that transcripts repeat from earlier ones, found with longest-previous-factor arrays.

Suffixes of a large collection cannot be sorted in one place, and most repeat nothing. Winnowing picks one anchor for every
string of ``match_bytes`` bytes, so equal strings have equal anchors; only strings whose anchor occurs in two
transcripts go on, to the task of their anchor. There their suffixes are sorted, and for each one the previous and
the next suffix of an earlier transcript give the longest factor that occurs before it.

At the edge of a passage that many transcripts share, one anchor has a different stretch in each of them. The strings of such an
anchor are dealt out one by one, by a hash of all their bytes, with the smallest key that each group has them in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aetherlog.llm.chunks import Piece, buffers, pieces
from aetherlog.llm.shared import text_bytes

GROUP_BYTES = 2 << 20    # text that one task holds at a time
BUCKET_BYTES = 8 << 20  # text for each bucket of anchors
STRINGS = 100_000        # strings that are sorted at a time, but for an anchor with more
HOT = 16                 # an anchor with differing stretches in this many groups is dealt out string by string,
HOT_GROUPS = 4_000       # and one that this many groups have
_PIECE = 1 << 19
_LOW = np.uint64(63)


def anchors(data: np.ndarray, offsets: np.ndarray, match_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, hash, first, last)``: anchors with the run of string starts they stand for, as places in the data.

    The anchor of a string is its gram with the smallest hash. Each start of a string belongs to one anchor.
    """
    gram = max(match_bytes // 2 + 1, match_bytes - 60)  # at most 61 grams a string: places are kept modulo 64
    width = match_bytes - gram + 1
    parts = []
    for a, b in pieces(offsets, _PIECE):
        base = int(offsets[a])
        piece = Piece(data[base:offsets[b]], offsets[a:b + 1] - base)
        n = len(piece.data)
        if n < match_bytes:
            continue
        at = np.arange(n - gram + 1)
        value = (piece.spans(at, at + gram) & ~_LOW) | (at.astype(np.uint64) & _LOW)
        least, span = value, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
        start = np.arange(len(least))  # starts of strings
        inside = np.zeros(n + 1, bool)
        for_rows = np.flatnonzero(np.diff(piece.offsets) >= match_bytes)
        step = np.zeros(n + 2, np.int32)
        step[piece.offsets[for_rows]] += 1
        step[piece.offsets[for_rows + 1] - match_bytes + 1] -= 1
        inside = np.cumsum(step)[:len(least)] > 0
        place = start + ((least & _LOW).astype(np.int64) - start) % 64
        head = inside.copy()
        head[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
        row_heads = piece.offsets[for_rows]
        head[row_heads] = True
        first = np.flatnonzero(head)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | head[1:]
        last = np.flatnonzero(ends)
        parts.append((piece.row_of(first) + a, least[first] >> np.uint64(6), first + base, last + base))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _bucketed(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted distinct hashes by bucket, and the edges of the buckets in that order."""
    bucket = ((values >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _group(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, bytes and offsets of a group's texts in order of key; null keys last."""
    table = table.sort_by([("key", "ascending")])
    data, offsets = buffers(table.column("body"))
    return table.column("key").combine_chunks(), data, offsets


def _hashes(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges inside rows; ``row`` ascends."""
    out = np.zeros(len(row), np.uint64)
    for a, b in pieces(offsets, _PIECE):
        i, j = np.searchsorted(row, a), np.searchsorted(row, b)
        if j > i:
            piece, base = Piece(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]), offsets[a]
            out[i:j] = piece.spans(first[i:j] - base, stop[i:j] - base)
    return out


def _mark(buckets: int, match_bytes: int):
    """Of a group: its distinct anchors by bucket, which of them two of its transcripts have, and which have differing stretches."""
    def run(table: pa.Table) -> pa.Table:
        _, data, offsets = _group(table)
        row, value, first, last = anchors(data, offsets, match_bytes)
        order = np.argsort(value, kind="stable")
        value, row, first, last = value[order], row[order], first[order], last[order]
        head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        twice = np.minimum.reduceat(row, head) != np.maximum.reduceat(row, head) if len(head) else np.zeros(0, bool)
        varied = np.zeros(len(head), bool)
        many = np.diff(np.append(head, len(value)))
        again = np.flatnonzero(np.repeat(many > 1, many))  # anchors that occur at one place only have one stretch
        if len(again):
            by_row = again[np.argsort(row[again], kind="stable")]
            same = np.zeros(len(value), np.uint64)
            same[by_row] = _hashes(data, offsets, row[by_row], first[by_row], last[by_row] + match_bytes)
            varied = np.minimum.reduceat(same, head) != np.maximum.reduceat(same, head)
        value = value[head]
        order, edges = _bucketed(value, buckets)
        full = np.flatnonzero(np.diff(edges))
        cut = [order[edges[b]:edges[b + 1]] for b in full]
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "g": pa.array([table.column("g")[0].as_py()] * len(full), pa.int64()),
            "tokens": pa.array([value[c].astype(np.uint32).tobytes() for c in cut], pa.binary()),
            "twice": pa.array([np.packbits(twice[c]).tobytes() for c in cut], pa.binary()),
            "varied": pa.array([np.packbits(varied[c]).tobytes() for c in cut], pa.binary())})
    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of a bucket: for each group's anchors a bit that tells whether two transcripts have it, and one for those dealt out string by string."""
    tokens = [np.frombuffer(t, np.uint32) for t in table.column("tokens").to_pylist()]

    def flags(name: str) -> np.ndarray:
        return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:len(t)] for x, t in zip(table.column(name).to_pylist(), tokens)])
    token, twice, varied = np.concatenate(tokens), flags("twice"), flags("varied")
    order = np.argsort(token, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
    many = np.diff(np.append(head, len(token)))
    shared, hot = np.empty(len(token), bool), np.empty(len(token), bool)
    shared[order] = np.repeat((many > 1) | (np.maximum.reduceat(twice[order], head) > 0), many)
    hot[order] = np.repeat((many >= HOT_GROUPS) | (np.add.reduceat(varied[order].astype(np.int64), head) >= HOT), many)
    ends = np.cumsum([len(t) for t in tokens])
    bits, hots = ([np.packbits(x[e - len(t):e]).tobytes() for t, e in zip(tokens, ends)] for x in (shared, hot))
    return pa.table({
        "g": table.column("g"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary()), "hot": pa.array(hots, pa.binary())})


def _merged(row: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of byte ranges, sorted by (row, first), as maximal ranges."""
    if not len(row):
        return row, first, stop
    order = np.lexsort((first, row))
    row, first, stop = row[order], first[order], stop[order]
    # places are global to the group, so ranges of later rows begin behind those of earlier ones
    reach = np.maximum.accumulate(stop)
    new = np.concatenate([[True], (first[1:] > reach[:-1]) | (row[1:] != row[:-1])])
    head = np.flatnonzero(new)
    return row[head], first[head], np.maximum.reduceat(stop, head)


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype(np.int64).tobytes(), 1)


def _contexts(buckets: int, match_bytes: int):
    """Of a group: the distinct stretches of text around repeated anchors, by bucket.

    A stretch, or a string of an anchor that is dealt out string by string, is sent for the smallest key of the group that has it. For the other transcripts that have it, all of it is a repeat.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("bucket", "g", "values", "keys", "starts", "counts", "body", "cut")
        types = (pa.int32(), pa.int64(), *(pa.binary(),) * 6)
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        keys, data, offsets = _group(left)
        row, value, first, last = anchors(data, offsets, match_bytes)
        distinct, which = np.unique(value, return_inverse=True)
        order, edges = _bucketed(distinct, buckets)
        shared, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        for b, bits, hots in zip(*(right.column(c).to_pylist() for c in ("bucket", "bits", "hot"))):
            part = order[edges[b]:edges[b + 1]]
            shared[part] = np.unpackbits(np.frombuffer(bits, np.uint8))[:len(part)].astype(bool)
            hot[part] = np.unpackbits(np.frombuffer(hots, np.uint8))[:len(part)].astype(bool)
        null = keys.is_null().to_numpy(zero_copy_only=False)
        hit = shared[which] & ~null[row]
        row, value, first, last, hot = row[hit], value[hit], first[hit], last[hit], hot[which][hit]
        number = keys.fill_null(0).to_numpy(zero_copy_only=False)
        if hot.any():  # a string is a stretch of its own, its hash takes the place of the anchor's
            count = np.where(hot, last - first + 1, 1)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row, value, first, last, hot = (np.repeat(x, count) for x in (row, value, first, last, hot))
            first = first + nth
            last = np.where(hot, first, last)
        same = _hashes(data, offsets, row, first, last + match_bytes)
        value = np.where(hot, same >> np.uint64(6), value)
        _, rep, which = np.unique(same, return_index=True, return_inverse=True)  # rows are in order of key: the first has the smallest
        later = number[row] > number[row[rep]][which]
        crow, cfirst, cstop = _merged(row[later], first[later], last[later] + match_bytes)
        cut = np.stack([number[crow], cfirst - offsets[crow], cstop - offsets[crow]]).astype(np.int64).tobytes() if len(crow) else None
        rep = np.flatnonzero(~later)  # all places where the smallest key has it
        bucket = ((value[rep] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        rep, edges = rep[by_bucket], np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        out: dict[str, list] = {n: [] for n in names}
        packer = zstandard.ZstdCompressor(level=1)
        g = left.column("g")[0].as_py()
        for b in np.flatnonzero(np.diff(edges)):
            r = rep[edges[b]:edges[b + 1]]
            size = last[r] - first[r] + match_bytes
            ends = np.cumsum(size)
            take = np.arange(ends[-1]) + np.repeat(first[r] - (ends - size), size)
            for n, v in zip(names, (
                    int(b), g, value[r].tobytes(), _packed(number[row[r]]), _packed(first[r] - offsets[row[r]]),
                    (last[r] - first[r] + 1).astype(np.uint8).tobytes(), packer.compress(data[take].tobytes()), None)):
                out[n].append(v)
        if cut is not None and not out["bucket"]:
            raise AssertionError("a repeat without a first copy")
        if cut is not None:
            out["cut"][0] = cut
        return pa.table({n: pa.array(out[n], t) for n, t in zip(names, types)})
    return run


def previous_factors(strings: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """LPF of fixed-length suffixes: how long a prefix of each occurs in a suffix of a smaller document, at most its length.

    ``strings`` has a row of bytes per suffix. In suffix order the longest such prefix is shared with the nearest suffix
    of a smaller document before it, or with the nearest one behind it. Both are found by pointer jumping, which carries the
    least common prefix on the way along.
    """
    n, length = strings.shape
    if not n:
        return np.zeros(0, np.int64)
    wide = np.zeros((n, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = strings
    words = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((doc, *(words[:, i] for i in range(words.shape[1] - 1, -1, -1))))
    s, d = strings[order], doc[order]
    equal = s[1:] == s[:-1]
    common = np.where(equal.all(axis=1), length, np.argmin(equal, axis=1)) if n > 1 else np.zeros(0, np.int64)
    best = np.zeros(n, np.int64)
    for forward in (False, True):
        dd = d[::-1] if forward else d
        lcp = np.concatenate([[0], common[::-1] if forward else common]).astype(np.int64)
        link, carry = np.arange(n) - 1, lcp.copy()
        live = np.flatnonzero((link >= 0) & (carry > 0))
        while len(live):
            to = link[live]
            live = live[dd[to] >= dd[live]]
            to = link[live]
            carry[live] = np.minimum(carry[live], carry[to])
            link[live] = link[to]
            gone = link[live] < 0
            carry[live[gone]] = 0
            live = live[~gone & (carry[live] > 0)]
        found = np.where(link >= 0, carry, 0)
        best = np.maximum(best, found[::-1] if forward else found)
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def _factors(match_bytes: int):
    """Of a bucket: the byte ranges of its stretches whose strings occur in a transcript with a smaller key."""
    def run(table: pa.Table) -> pa.Table:
        def joined(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

        def unpacked(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(zstandard.decompress(x) for x in table.column(name).to_pylist()), kind)
        value, key, start = joined("values", np.uint64), unpacked("keys", np.int64), unpacked("starts", np.int64)
        count, body = joined("counts", np.uint8).astype(np.int64), unpacked("body", np.uint8)
        g = np.repeat(np.array(table.column("g").to_pylist(), np.int64), [len(v) // 8 for v in table.column("values").to_pylist()])
        size = count + match_bytes - 1
        place = np.cumsum(size) - size
        # equal stretches: only the smallest key's one can be new
        piece_hash = np.zeros(len(value), np.uint64)
        for a, b in pieces(np.append(place, len(body)), _PIECE):
            base = place[a]
            piece = Piece(body[base:(place[b] if b < len(place) else len(body))], np.array([0]))
            piece_hash[a:b] = piece.spans(place[a:b] - base, place[a:b] + size[a:b] - base)
        order = np.lexsort((key, piece_hash, value))
        v, h = value[order], piece_hash[order]
        head = np.concatenate([[True], (v[1:] != v[:-1]) | (h[1:] != h[:-1])])
        rep = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        first_copy = np.empty(len(value), np.int64)
        first_copy[order] = rep
        copy = (first_copy != np.arange(len(value))) & (key != key[first_copy])
        # stretches whose anchor has other stretches, too: their strings are compared
        news = np.concatenate([[True], v[1:] != v[:-1]])
        several = np.add.reduceat(head.astype(np.int64), np.flatnonzero(news))[np.cumsum(news) - 1] > 1
        kept = order[several & ~copy[order]]
        gs, ks, a, z = [g[copy]], [key[copy]], [start[copy]], [start[copy] + size[copy]]
        # whole anchors together, a bounded number of strings at a time
        edges = np.flatnonzero(np.concatenate([[True], value[kept][1:] != value[kept][:-1]])) if len(kept) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(count[kept])])
        i = 0
        while i < len(edges):
            j = i + 1
            while j < len(edges) and upto[edges[j + 1] if j + 1 < len(edges) else len(kept)] - upto[edges[i]] <= STRINGS:
                j += 1
            k = kept[edges[i]:edges[j] if j < len(edges) else len(kept)]
            owner = np.repeat(k, count[k])
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count[k]) - count[k], count[k])
            strings = body[(place[owner] + nth)[:, None] + np.arange(match_bytes)]
            old = previous_factors(strings, key[owner]) >= match_bytes
            gs.append(g[owner[old]])
            ks.append(key[owner[old]])
            a.append(start[owner[old]] + nth[old])
            z.append(start[owner[old]] + nth[old] + match_bytes)
            i = j
        gs, ks, a, z = map(np.concatenate, (gs, ks, a, z))
        for gg, c in zip(table.column("g").to_pylist(), table.column("cut").to_pylist()):
            if c is not None:
                more = np.frombuffer(c, np.int64).reshape(3, -1)
                gs, ks, a, z = (np.concatenate(x) for x in ((gs, np.full(more.shape[1], gg)), (ks, more[0]), (a, more[1]), (z, more[2])))
        order = np.lexsort((a, ks, gs))
        gs, ks, a, z = gs[order], ks[order], a[order], z[order]
        head = np.flatnonzero(np.concatenate([[True], gs[1:] != gs[:-1]])) if len(gs) else np.zeros(0, np.int64)
        cut = [slice(x, y) for x, y in zip(head, np.append(head[1:], len(gs)))]
        return pa.table({"g": pa.array(gs[head], pa.int64()), "cut": pa.array(
            [np.stack([ks[c], a[c], z[c]]).astype(np.int64).tobytes() for c in cut], pa.binary())})
    return run


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of a group: its texts without the ranges to cut."""
    keys, data, offsets = _group(left)
    cuts = np.concatenate([np.frombuffer(c, np.int64).reshape(3, -1) for c in right.column("cut").to_pylist()] or [np.zeros((3, 0), np.int64)], axis=1)
    null = keys.is_null().to_numpy(zero_copy_only=False)
    number = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = np.ones(len(data), bool)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(number))]
    order = np.argsort(cuts[0], kind="stable")
    cuts = cuts[:, order]
    for r in np.flatnonzero(~null):
        i, j = np.searchsorted(cuts[0], number[r], "left"), np.searchsorted(cuts[0], number[r], "right")
        if j > i:
            _, first, stop = _merged(np.zeros(j - i, np.int64), cuts[1, i:j], cuts[2, i:j])
            stop = np.minimum(stop, offsets[r + 1] - offsets[r])
            for x, y in zip(first.tolist(), stop.tolist()):
                keep[offsets[r] + x:offsets[r] + y] = False
                spans[r].append((x, y))
    kept = [data[a:b][keep[a:b]].tobytes() if s else data[a:b].tobytes() for a, b, s in zip(offsets, offsets[1:], spans)]
    size = np.diff(offsets)
    return pa.table({
        "key": keys, "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(size, pa.int64()),
        "n_removed": pa.array(size - np.array([len(k) for k in kept], np.int64), pa.int64()),
        "spans": pa.array([[{"start": x, "stop": y} for x, y in s] for s in spans],
                          pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))})


def remove_repeats(transcripts: DataFrame, key: str = "transcript_id", text: str = "text", match_bytes: int = 50) -> DataFrame:
    """Every transcript without the bytes that repeat a transcript with a smaller key.

    A byte goes if it is covered by a string of ``match_bytes`` bytes of the transcript that also starts in one with a
    smaller key; strings overlap, and are judged on the whole input. Returns key (BIGINT), kept (the remaining bytes, not always whole UTF-8
    characters), n_bytes, n_removed and spans (maximal removed ranges: start, stop). ``key`` is an integer.
    Texts are bytes of UTF-8, null ones empty. Rows with a null key are returned as they are and take no part. Rows that share a
    key do not repeat one another. Texts shorter than ``match_bytes`` stay; an empty table gives an empty one.
    """
    total = text_bytes(transcripts, text)
    groups, buckets = int(max(1, -(-total // GROUP_BYTES))), int(max(16, -(-total // BUCKET_BYTES)))
    number = F.col(key).cast("bigint")
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = transcripts.select(F.pmod(F.xxhash64(number), F.lit(groups)).alias("g"), number.alias("key"), body.alias("body"))
    marked = rows.groupBy("g").applyInArrow(_mark(buckets, match_bytes), "bucket INT, g BIGINT, tokens BINARY, twice BINARY, varied BINARY")
    shared = marked.groupBy("bucket").applyInArrow(_repeated, "g BIGINT, bucket INT, bits BINARY, hot BINARY")
    around = rows.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(
        _contexts(buckets, match_bytes),
        "bucket INT, g BIGINT, values BINARY, keys BINARY, starts BINARY, counts BINARY, body BINARY, cut BINARY")
    cuts = around.groupBy("bucket").applyInArrow(_factors(match_bytes), "g BIGINT, cut BINARY")
    out = rows.groupBy("g").cogroup(cuts.groupBy("g")).applyInArrow(
        _cut, "key BIGINT, kept BINARY, n_bytes BIGINT, n_removed BIGINT, spans ARRAY<STRUCT<start: BIGINT, stop: BIGINT>>")
    return out.withColumnRenamed("key", key)


def reference_sql(match_bytes: int = 50) -> str:
    """The result over ``documents`` from SQL: a row per byte string, so for small tables only."""
    n = match_bytes
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * n}) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {n - 1})) AS i FROM d)),
origin AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN origin USING (s) WHERE f < doc_id),
run AS (
  SELECT doc_id, min(i) AS a, max(i) + {n} AS z FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (
      SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {n} THEN 0 ELSE 1 END AS fresh FROM hit))
  GROUP BY doc_id, r),
rest AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b, a AS e FROM run
  UNION ALL SELECT doc_id, coalesce(z, 0), len(h) // 2 FROM d LEFT JOIN (SELECT doc_id, max(z) AS z FROM run GROUP BY 1) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2 * (e - b)), '' ORDER BY b) AS k FROM rest JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r.removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(r.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM run GROUP BY 1) r USING (doc_id)"""
