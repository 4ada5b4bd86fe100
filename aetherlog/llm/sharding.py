"""Contiguous shards of transcripts whose largest one is as small as possible."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aetherlog.llm.shared import stored

_TOP = 16          # bits of the order key that the first overview tells apart
_STEP = 10         # further bits of each refinement
_SLOT_BLOCKS = 12  # bits of the blocks that number their rows separately


class _Overview:
    """Sizes of consecutive ranges of the order key, finer where a cut may fall.

    Bounded whatever the table holds: 65,536 ranges at first and at most 1,024 more for every refined one.
    """

    def __init__(self, groups: DataFrame):
        self.groups = groups
        rows = self._ranges(groups, 64 - _TOP)
        self.start, self.bits, self.size, self.n = (np.array(x) for x in zip(*rows)) if rows else (np.zeros(0, object),) * 4

    @staticmethod
    def _ranges(groups: DataFrame, bits: int) -> list[tuple]:
        cut = F.shiftleft(F.shiftright("order_key", bits), bits) if bits else F.col("order_key")
        found = groups.groupBy(cut.alias("start")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        return sorted((r["start"], bits, int(r["size"]), int(r["n"])) for r in found)

    def prefix(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size.astype(np.int64))])

    def refine(self, at: set[int]) -> None:
        """Split these ranges by their next bits; one job for all of them."""
        where, rows = F.lit(False), [r for i, r in enumerate(zip(self.start, self.bits, self.size, self.n)) if i not in at]
        by_bits: dict[int, list[int]] = {}
        for i in at:
            by_bits.setdefault(int(self.bits[i]), []).append(int(self.start[i]))
        for bits, starts in by_bits.items():
            where = F.lit(False)
            for s in starts:
                where = where | F.col("order_key").between(s, s + (1 << bits) - 1)
            rows += self._ranges(self.groups.filter(where), max(0, bits - _STEP))
        rows.sort()
        self.start, self.bits, self.size, self.n = (np.array(x) for x in zip(*rows))

    def fill(self, prefix: np.ndarray, shards: int, capacity: int, optimistic: bool) -> tuple[bool, list[int], set[int]]:
        """Greedy filling: does it reach the end, the ranges that begin a new shard, the ranges left in doubt."""
        at, cuts, doubt = 0, [], set()
        for _ in range(shards):
            target = at + capacity
            if target >= prefix[-1]:
                return True, cuts, doubt
            i = int(np.searchsorted(prefix, target, "right")) - 1
            if prefix[i] < target and self.n[i] > 1:
                doubt.add(i)
                at = target if optimistic else int(prefix[i])
            else:
                at = int(prefix[i])
            cuts.append(i)
        return False, cuts, doubt


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity of ``shards`` contiguous shards, and the order keys at which they begin.

    ``groups`` has one row (order_key, size) per atomic group. Binary search over the capacity; a capacity is
    checked by filling shards greedily in order. The check uses range sizes; where the answer
    depends on how a range divides, that range is split further until it does not.
    """
    overview = _Overview(groups)
    prefix = overview.prefix()
    total = int(prefix[-1])
    if not total:
        return 0, []
    largest = int(groups.agg(F.max("size")).first()[0])
    low = max(-(-total // shards), largest)
    high = low + largest
    while True:
        capacity = (low + high) // 2 if low < high else high
        sure, cuts, doubt = overview.fill(prefix, shards, capacity, optimistic=False)
        maybe, _, more = overview.fill(prefix, shards, capacity, optimistic=True)
        if low < high and sure:
            high = capacity
        elif low < high and not maybe:
            low = capacity + 1
        elif not doubt and not more:
            return capacity, [int(overview.start[i]) for i in cuts]
        else:
            overview.refine(doubt | more)
            prefix = overview.prefix()


def _order_key(body: Column) -> Column:
    """The first 60 bits of the text's MD5, moved to the whole range of a BIGINT's upper bits."""
    return F.conv(F.substring(F.md5(body.cast("binary")), 1, 15), 16, 10).cast("bigint") * 8


def minimax_shards(transcripts: DataFrame, key: str = "transcript_id", text: str = "text", shards: int = 8,
                   rows_per_cell: int = 1000) -> DataFrame:
    """Put every transcript into one of ``shards`` contiguous shards of nearly equal size.

    Returns key, size, text_crc32, law, shard, slot, grown_shard. ``size`` is the text's UTF-8 bytes plus 1 (null: 1).
    Atomic groups are equal texts (a null text counts as an empty one), ordered by a hash of 60 bits of
    the text, so that a shard is a range of hashes and needs no join. The law is ``bytes``: the largest shard is as
    small as contiguous shards allow. Slots count from 0 in each shard without gaps, ordered by block of hashes.
    Rows are numbered in cells of about ``rows_per_cell`` rows; a block with more, say of one hot text,
    is salted by key. Repeated rows get slots of their own. Too few groups leave shards empty.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = transcripts.select(
        F.col(key), (F.octet_length(body).cast("bigint") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), _order_key(body).alias("order_key"))
    rows = stored(rows, "sharding-rows")
    groups = stored(rows.groupBy("order_key").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "sharding-groups")
    _, cuts = minimax_cuts(groups.select("order_key", "size"), shards)

    shard = sum((F.when(F.col("order_key") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    block = F.shiftright("order_key", 64 - _SLOT_BLOCKS)
    salts = F.broadcast(groups.groupBy(block.alias("block")).agg(  # at most 4,096 rows
        F.ceil(F.sum("rows") / rows_per_cell).cast("bigint").alias("salts")))
    placed = rows.withColumn("shard", shard).withColumn("block", block).join(salts, "block").withColumn(
        "salt", F.pmod(F.xxhash64(key), "salts"))
    cell = ["shard", "block", "salt"]
    cells = placed.groupBy(*cell).count()
    blocks = cells.groupBy("shard", "block").agg(F.sum("count").alias("n"))  # at most 4,096 rows and one a cut
    blocks = blocks.select("shard", "block", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    offsets = cells.join(F.broadcast(blocks), ["shard", "block"]).select(*cell, (F.col("base") + F.coalesce(F.sum("count").over(
        Window.partitionBy("shard", "block").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset"))
    numbered = placed.withColumn("__n", F.row_number().over(
        Window.partitionBy(*cell).orderBy("order_key", key, "text_crc32")))
    return numbered.join(offsets, cell).select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("__n") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def reference_sql(shards: int = 8) -> str:
    """The result over ``documents`` from SQL: every way to divide the groups, so for small tables only.

    Slots agree as long as no block of hashes holds more rows than a cell.
    """
    levels = "".join(f"""
f{k} AS (SELECT p.i, min(greatest(f.best, p.upto - q.upto)) AS best FROM pre p JOIN f{k - 1} f ON f.i <= p.i JOIN pre q ON q.i = f.i GROUP BY p.i),"""
                     for k in range(2, shards + 1))
    return f"""
WITH RECURSIVE step AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS crc FROM step WHERE k = 8),
bytes AS (SELECT doc_id, list_transform(range(0, strlen(coalesce(text, ''))), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents)),
sums AS (SELECT doc_id, xor(list_reduce(b, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM bytes, tab),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, size, t, ('0x' || substr(md5(t), 1, 15))::BIGINT AS k FROM d),
g AS (SELECT k, sum(size) AS size FROM o GROUP BY k),
pre AS (SELECT row_number() OVER (ORDER BY k) AS i, k, sum(size) OVER (ORDER BY k) AS upto FROM g UNION ALL SELECT 0, NULL, 0),
f1 AS (SELECT i, upto AS best FROM pre),{levels}
cap AS (SELECT best AS c FROM f{shards} ORDER BY i DESC LIMIT 1),
cut AS (
  SELECT 0 AS shard, 0::BIGINT AS i
  UNION ALL SELECT shard + 1, (SELECT max(p.i) FROM pre p WHERE p.upto <= (SELECT upto FROM pre q WHERE q.i = cut.i) + (SELECT c FROM cap))
  FROM cut WHERE shard < {shards - 1}),
place AS (SELECT p.k, max(cut.shard) AS shard FROM pre p JOIN cut ON cut.i < p.i GROUP BY p.k)
SELECT doc_id, CAST(o.size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(NULL AS INTEGER) AS grown_shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS BIGINT) AS slot
FROM o JOIN place USING (k) JOIN sums USING (doc_id)"""
