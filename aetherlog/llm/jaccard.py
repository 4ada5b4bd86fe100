"""Transcripts whose sets of word shingles are alike: an exact similarity join.

Most transcripts resemble no other one. A transcript of n shingles can only be linked if 80 percent of them occur
in transcripts with other sets, so a first pass finds which shingles do, without moving texts. The sets
that are left are searched in groups that share a leader: for each query set the inverted lists of a group are searched for sets with
the required overlap (T-occurrence): its short lists are merged, the long ones probed by binary search only for what the
merge has left (DivideSkip).

A family of near copies is linked through its leader, in shards of bounded size, so that no group is compared pair by
pair. What could still link two families is found by the same bound, and searched in full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aetherlog.llm.chunks import Piece, buffers, mix, pieces
from aetherlog.llm.components import components
from aetherlog.llm.shared import stored, text_bytes

WORDS, PERCENT = 5, 80
_BLOCK = 2 << 20        # bytes of text whose shingles a task counts together
_BUCKET = 32 << 20     # bytes of text for each bucket of shingles: blocks times buckets rows are moved
_PARTS = 8              # in which a bucket's shingles are counted, a power of two
_PIECE = 1 << 19
_MOST_BITS = 1 << 27    # of the map of wanted keys


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted hashes)`` of each text's distinct shingles; A-Z in lower case."""
    data, offsets = buffers(texts)
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    factor = mix(np.arange(1, words + 1, dtype=np.uint64))
    for a, b in pieces(offsets, _PIECE):
        piece = Piece(low[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        starts, ends, first = piece.words()
        w = piece.spans(starts, ends)
        whole = np.zeros(max(0, len(w) - words + 1), np.uint64)
        for i in range(words):
            whole += w[i:len(w) - words + 1 + i] * factor[i] if len(whole) else 0
        whole = mix(whole)
        for r in range(b - a):
            n = first[r + 1] - first[r]
            if n >= words:
                yield a + r, np.unique(whole[first[r]:first[r + 1] - words + 1])
            elif n:
                value = (w[first[r]:first[r + 1]] * factor[:n]).sum(dtype=np.uint64, keepdims=True)
                yield a + r, mix(value + factor[n - 1:n] * np.uint64(7))
            else:
                yield a + r, np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    return int(mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0


def set_sizes(transcripts: DataFrame, key: str = "transcript_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """key, n_shingles, d1, d2: size and two digests of each transcript's set. Null texts have the empty set."""
    source = transcripts.select(F.col(key), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for r, s in shingle_sets(batch.column(1), words):
                n[r], d1[r], d2[r] = len(s), s.sum(dtype=np.uint64).astype(np.int64), _digest(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, d1, d2))], names=[key, "n_shingles", "d1", "d2"])

    return source.mapInArrow(run, f"`{key}` {source.dtypes[0][1]}, n_shingles BIGINT, d1 BIGINT, d2 BIGINT")


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as many bytes each as the largest needs, and that width."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.dtype(f"u{data[0]}"), offset=1).astype(np.int64)


def _block_rows(batch: pa.RecordBatch, buckets: int, words: int) -> Iterator[pa.RecordBatch]:
    """Shingles of a block of texts, packed by bucket and there by member; equal sets of the block once.

    The place of a shingle says whose it is: ``members`` has the steps from one member with shingles in the bucket to the next, ``each``
    how many each of them has, last the shingles known to be shared. So a row is in proportion to its shingles, however many buckets
    there are.
    """
    keys = batch.column(0)
    seen: dict[int, int] = {}
    members, sets = [], []
    for r, s in shingle_sets(batch.column(1), words):
        d = _digest(s)
        if len(s) and (d not in seen or len(sets[seen[d]]) != len(s)):
            seen[d] = len(sets)
            members.append(r)
            sets.append(s)
        elif len(s) and keys[r].as_py() is not None and (
                keys[members[seen[d]]].as_py() is None or keys[r].as_py() < keys[members[seen[d]]].as_py()):
            members[seen[d]] = r
    if not sets:
        return
    size = np.array([len(s) for s in sets], np.int64)
    digest = np.array([_digest(s) & 0xFFFFFFFF for s in sets], np.uint32)
    token, member = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
    del sets
    order = np.argsort(token, kind="stable")
    token, member = token[order], member[order]
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    many = np.diff(np.append(head, len(token)))
    local = np.bincount(member[np.repeat(many > 1, many)], minlength=len(size))
    token, member = token[head], np.where(many > 1, len(size), member[head]).astype(np.int32)
    bucket = ((token >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((member, bucket))
    block = _digest(token) ^ zlib.crc32(str(keys[members[0]].as_py()).encode())  # the same when a task runs again
    token, member, edges = token[order].astype(np.uint32), member[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    kept = keys.take(pa.array(members))
    out: dict[str, list] = {k: [] for k in ("bucket", "block", "tokens", "members", "each", "digests", "keys", "sizes", "local")}
    for b in np.flatnonzero(np.diff(edges) > 0):
        part = slice(edges[b], edges[b + 1])
        own = not out["bucket"]  # one of the rows carries what the block's end needs
        each = np.bincount(member[part], minlength=len(size) + 1)
        held = np.flatnonzero(each[:-1])
        for k, v in (("bucket", int(b)), ("block", block), ("tokens", token[part].tobytes()), ("members", _packed(np.diff(held, prepend=0))),
                     ("each", _packed(np.append(each[held], each[-1]))), ("digests", digest[held].tobytes()),
                     ("keys", kept if own else None), ("sizes", size.tobytes() if own else None),
                     ("local", local.astype(np.int64).tobytes() if own else None)):
            out[k].append(v)
    listed = pa.ListArray.from_arrays(
        pa.array([0] + [len(kept)] * len(out["bucket"]), pa.int32()), kept, mask=pa.array([i > 0 for i in range(len(out["bucket"]))]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(out["bucket"], pa.int32()), pa.array(out["block"], pa.int64()), *(pa.array(out[k], pa.binary()) for k in ("tokens", "members", "each", "digests")),
         listed, *(pa.array(out[k], pa.binary()) for k in ("sizes", "local"))], names=list(out))


def _count_shared(table: pa.Table) -> pa.Table:
    """For one bucket: which members have shingles that also occur in another set, and how many."""
    token = buffers(table.column("tokens"))[0].view(np.uint32)
    owners = [np.cumsum(_unpacked(x)) for x in table.column("members").to_pylist()]
    # a run of shingles per member and block, and one of those known to be shared
    run = np.concatenate([_unpacked(x) for x in table.column("each").to_pylist()])
    mark = np.concatenate([np.append(np.frombuffer(d, np.uint32), np.uint32(0)) for d in table.column("digests").to_pylist()])
    known = np.concatenate([np.append(np.zeros(len(o), bool), True) for o in owners])
    whose = np.repeat(np.arange(len(run), dtype=np.int32), run)
    count = np.zeros(len(run), np.int64)
    part = (token >> np.uint32(32 - _PARTS.bit_length() + 1)).astype(np.uint8)
    for k in range(_PARTS):  # some of the shingles at a time
        at = np.flatnonzero(part == k)
        if not len(at):
            continue
        at = at[np.argsort(token[at], kind="stable")]
        t, w = token[at], whose[at]
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        many, m = np.diff(np.append(head, len(t))), mark[w]
        mixed = (np.minimum.reduceat(m, head) != np.maximum.reduceat(m, head)) | np.maximum.reduceat(known[w], head)
        count += np.bincount(w[np.repeat(mixed, many)], minlength=len(run))
    ids, counts, end = [], [], 0
    for o in owners:
        c, end = count[end:end + len(o)], end + len(o) + 1
        ids.append(_packed(o[c > 0]))
        counts.append(_packed(c[c > 0]))
    return pa.table({"block": table.column("block"), "ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary()),
                     "keys": table.column("keys"), "sizes": table.column("sizes"), "local": table.column("local")})


def _block_end(percent: int, key_type: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        for k, s, l in zip(*(table.column(n) for n in ("keys", "sizes", "local"))):
            if s.is_valid:
                keys, size, total = k.values, np.frombuffer(s.as_py(), np.int64), np.frombuffer(l.as_py(), np.int64).copy()
        for i, c in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist()):
            total[_unpacked(i)] += _unpacked(c)
        enough = np.flatnonzero(100 * total >= percent * size)
        return pa.table({"key": keys.take(pa.array(enough))})
    return run


def linkable(transcripts: DataFrame, key: str, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Keys of transcripts with so many shingles in common with other sets that a link is possible.

    One row per distinct set and block at least has the smallest key of its set there. Blocks send each of their distinct
    shingles once; one that a block has in two sets, like those of a passage many share, travels without its members.
    """
    buckets = int(max(16, -(-text_bytes(transcripts, text) // _BUCKET)))
    source = transcripts.select(F.col(key), F.col(text).cast("string").alias("__text"))
    kind = source.dtypes[0][1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for a, b in pieces(offsets, _BLOCK):
                yield from _block_rows(batch.slice(a, b - a), buckets, words)

    rest = f"keys ARRAY<{kind}>, sizes BINARY, local BINARY"
    packed = source.mapInArrow(pack, f"bucket INT, block BIGINT, tokens BINARY, members BINARY, each BINARY, digests BINARY, {rest}")
    counted = packed.groupBy("bucket").applyInArrow(_count_shared, f"block BIGINT, ids BINARY, counts BINARY, {rest}")
    return counted.groupBy("block").applyInArrow(_block_end(percent, None), f"key {kind}")


def required(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray:
    """Least overlap of sets with n and m members: 100 * overlap >= percent * (n + m - overlap)."""
    return -(-percent * (np.asarray(n) + m) // (100 + percent))


def divide_skip(sets: list[np.ndarray], queries: list[int], percent: int, known: np.ndarray) -> list[tuple[int, int]]:
    """Links of the query sets with all sets, found by T-occurrence search; sets known to be connected are skipped.

    ``known`` holds a label per set; sets of one label are connected already. Every pair of labels with a link
    gets one at least, as labels are merged when a link is found.
    """
    label = known.copy()
    size = np.array([len(s) for s in sets])
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    links = []
    for q in queries:
        own = sets[q]
        least = -(-percent * size[q] // 100)          # whatever the other set's size
        lo, hi = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
        length = hi - lo
        by_length = np.argsort(length, kind="stable")
        long_ones = min(int(least) - 1, int(0.8 * size[q]))  # lists that are probed only
        short = by_length[:len(own) - long_ones]
        take = length[short]
        at = np.repeat(lo[short] - np.concatenate([[0], np.cumsum(take)[:-1]]), take) + np.arange(take.sum())
        count = np.bincount(owner[at], minlength=len(sets))
        need = required(size[q], size, percent)
        can = (count >= need - long_ones) & (label != label[q]) & (100 * np.minimum(size, size[q]) >= percent * np.maximum(size, size[q]))
        probes = np.sort(own[by_length[len(own) - long_ones:]])
        for c in np.flatnonzero(can):
            if label[c] == label[q]:
                continue
            place = np.minimum(np.searchsorted(sets[c], probes), size[c] - 1)
            if count[c] + (sets[c][place] == probes).sum() >= need[c]:
                links.append((q, int(c)))
                label[label == label[c]] = label[q]
    return links


def _search(percent: int):
    def run(table: pa.Table) -> pa.Table:
        keys = table.column("rep").combine_chunks()
        lists = table.column("tokens").combine_chunks()
        off = lists.offsets.to_numpy()
        flat = lists.values.to_numpy().view(np.uint64)
        sets = [np.sort(flat[a:b]) for a, b in zip(off, off[1:])]
        names, known = np.unique(np.array(table.column("comp").to_pylist(), object).astype(str), return_inverse=True)
        queries = np.flatnonzero(table.column("query").to_numpy(zero_copy_only=False)).tolist()
        found = divide_skip(sets, queries, percent, known)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": keys.take(pa.array(a, pa.int64())), "b": keys.take(pa.array(b, pa.int64()))})
    return run


def _links(assigned: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside the groups of ``assigned`` (grp, shard, rep, comp, query)."""
    kind = dict(sets.dtypes)["rep"]
    full = assigned.join(sets.select("rep", "tokens"), "rep").select("grp", "shard", "rep", "comp", "query", "tokens")
    return full.groupBy("grp", "shard").applyInArrow(_search(percent), f"a {kind}, b {kind}")


def family_links(sets: DataFrame, percent: int, shard_shingles: int, share: int = 8) -> DataFrame:
    """Links that connect most of each family of near copies.

    The leader of a shingle is the smallest set that has it; a set joins the groups of the leaders that a fifth of its sampled shingles
    have (one in ``share``, by hash: what this step misses the next one finds). A group is dealt out to shards of about
    ``shard_shingles`` shingles, each with the leader.
    """
    token = sets.select("rep", F.explode("tokens").alias("token")).filter(F.pmod("token", F.lit(share)) == 0)
    lead = token.groupBy("token").agg(F.min("rep").alias("grp"), F.count("*").alias("n")).filter("n > 1").select("token", "grp")
    lead = stored(lead, "jaccard-leaders")  # a table of its own: both sides of the join are shuffled as they are, and a hot shingle's part is split
    joined = token.join(lead, "token").groupBy("rep", "grp").count()
    own = token.groupBy("rep").agg(F.count("*").alias("n"))
    member = joined.filter("rep != grp").join(own, "rep").filter("5 * count >= n").select("grp", "rep", "n")
    width = member.groupBy("grp").agg(F.ceil(F.sum("n") * share / shard_shingles).alias("shards"))
    dealt = member.join(width, "grp").select("grp", F.pmod(F.xxhash64("rep"), "shards").alias("shard"), "rep", F.lit(True).alias("query"))
    heads = width.select("grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"),
                         F.col("grp").alias("rep"), F.lit(False).alias("query"))
    return _links(dealt.unionByName(heads).withColumn("comp", F.col("rep")), sets, percent)


def _rare(sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each set, one at least of which any linked set of another component has, too: (token, rep, comp, n).

    Shingles are put in one order for all: first those of one component alone, which cannot link, then by the number of sets that have
    them. A linked set shares ``percent`` of n shingles, so the first shingle that both have is among the n - percent * n + 1 first
    ones of either. Common passages come last and bring together only sets that hold little else.
    """
    token = stored(sets.select("rep", "comp", F.explode("tokens").alias("token")), "jaccard-able")
    mixed = stored(token.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter(
        "x != y").select("token", "df"), "jaccard-frequencies")
    held = token.select("rep", "token").join(mixed, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    n, least = F.col("n_shingles"), F.ceil(F.col("n_shingles") * percent / 100)
    enough = sets.select("rep", "comp", "n_shingles").join(held, "rep").filter(F.size("held") >= least)
    first = F.slice("held", F.lit(1), (F.size("held") - least + 1).cast("int"))
    return enough.select("rep", "comp", n.alias("n"), F.explode(first).alias("t")).select("t.token", "rep", "comp", "n")


def remaining_links(sets: DataFrame, comp: DataFrame, percent: int, shard_shingles: int) -> DataFrame:
    """All links between sets of different components that ``comp`` (rep, comp) does not connect yet.

    Of the 40 percent smallest shingles of each of two linked sets, each shares at least a fifth of its size with
    the other. So a set matters only if so many of them occur in other components; the rest meet in groups by the leaders of their
    rarest shingles, every query with every shard of its groups. Shards of a large group are larger, up to four times, as
    a set is sent once for each shard.
    """
    slack = 100 - percent
    cut = F.slice("tokens", 1, F.ceil(F.size("tokens") * 2 * slack / 100).cast("int") + 1)
    token = sets.join(comp, "rep").select("rep", "comp", F.col("n_shingles").alias("n"), F.explode(cut).alias("token"))
    mixed = token.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("token")
    token = token.join(stored(mixed, "jaccard-mixed-tokens"), "token")
    able = token.groupBy("rep", "comp", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= F.col("n") * slack / 100 - 2).select("rep", "comp")
    able = sets.join(stored(able, "jaccard-mixed"), "rep")
    token = stored(_rare(able, percent), "jaccard-rare")
    lead = token.groupBy("token").agg(F.min("rep").alias("grp"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y")
    member = stored(token.join(stored(lead.select("token", "grp"), "jaccard-mixed-leaders"), "token").select("grp", "rep", "comp", "n").distinct(), "jaccard-groups")
    parts = F.sum("n") / shard_shingles
    width = member.groupBy("grp").agg(F.ceil(parts / F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.sqrt(parts)))).alias("shards"))
    dealt = member.join(width, "grp").withColumn("own", F.pmod(F.xxhash64("rep"), "shards"))
    # a task gets two shards at most: the first one's sets are searched for the second one's
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    assigned = pairs.select("grp", (low * F.col("shards") + high).alias("shard"), "rep", "comp", (F.col("own") == high).alias("query"))
    return _links(assigned, sets, percent)


def _wanted(keys: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A map of the keys' hashes, one bit in 16 set, and the number of its bits: who is not in it is no key."""
    bits = min(_MOST_BITS, 1 << max(15, (16 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    rows = keys.select(place.alias("place")).groupBy(
        F.bitmap_bucket_number("place").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096:][:len(r["m"])] = np.frombuffer(r["m"], np.uint8)
    return out, bits


def similar_transcripts(transcripts: DataFrame, key: str = "transcript_id", text: str = "text", words: int = WORDS,
                        percent: int = PERCENT, shard_shingles: int = 100_000) -> DataFrame:
    """One row per transcript: key, n_shingles, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a transcript's set holds its distinct shingles of ``words`` words, or its
    whole sequence if it has fewer. Two transcripts are linked when 100 * overlap >= percent * union of their sets;
    component_id is the smallest key reachable by links. A transcript without words, or with a null text, has the empty set and
    is its own component. Equal sets are one class and searched once; a class without a key that is not null stays alone.
    Repeated rows give repeated results, an empty table an empty one. Sets are compared by 64-bit hashes of their shingles.
    """
    sizes = stored(set_sizes(transcripts, key, text, words), "jaccard-sizes")
    digest = ["n_shingles", "d1", "d2"]
    classes = sizes.filter("n_shingles > 0").groupBy(*digest).agg(F.min(key).alias("rep"))
    able = linkable(transcripts, key, text, words, percent)
    # the smallest key of a class is the smallest one of its block, too
    chosen = classes.join(able.select(F.col("key").alias("rep")).distinct(), "rep", "left_semi").filter("rep IS NOT NULL").select("rep")
    chosen = stored(chosen, "jaccard-chosen")
    # texts are not moved: sets are made of those whose keys may be wanted, and the others of these dropped
    wanted, bits = _wanted(chosen, "rep")
    body = transcripts.select(F.col(key).alias("rep"), F.pmod(F.xxhash64(F.col(key)), F.lit(bits)).alias("__place"), F.col(text).cast("string").alias("__text"))
    kind = body.dtypes[0][1]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((wanted[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            found = [s for _, s in shingle_sets(batch.column(2), words)]
            size = np.array([len(s) for s in found], np.int64)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), lists], names=["rep", "n_shingles", "tokens"])

    sets = body.mapInArrow(unpack, f"rep {kind}, n_shingles BIGINT, tokens ARRAY<BIGINT>").join(chosen, "rep", "left_semi")
    sets = stored(sets.dropDuplicates(["rep"]), "jaccard-sets")
    first = stored(family_links(sets, percent, max(1, shard_shingles // 4)), "jaccard-links")
    comp = components(first)
    comp = stored(sets.select("rep").join(comp, F.col("rep") == F.col("node"), "left").select(
        "rep", F.coalesce("component", "rep").alias("comp")), "jaccard-components")
    more = remaining_links(sets, comp, percent, shard_shingles)
    merged = components(first.unionByName(more))
    of_class = classes.join(merged, F.col("rep") == F.col("node"), "left").select(
        *digest, F.coalesce("component", "rep").alias("component_id"))
    return sizes.join(of_class, digest, "left").select(
        key, "n_shingles", F.when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.col("component_id")).alias("component_id"))


def reference_sql(words: int = WORDS, percent: int = PERCENT) -> str:
    """The result over ``documents`` from SQL: all pairs with a shingle in common, so for small tables only."""
    return f"""
WITH RECURSIVE spoken AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM spoken),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id
FROM sets JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY 1) c ON c.x = doc_id"""
