"""Transcripts drawn towards a target: importance weights over hashed words, found by an Aho-Corasick dictionary.

Each piece of text gets a dictionary of its distinct words, bounded by a delimiter on both sides, so that only whole words
match. A word carries its CRC-32 and its length as payload; one scan of the automaton emits the payloads in the order of the
text, and the payloads of adjacent words compose to those of runs of words without another look at the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aetherlog.llm.chunks import PIECE, buffers
from aetherlog.llm.shared import stored

# A-Z in lower case; digits, letters and all bytes of other characters stay; the rest delimits words
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LONG = 1024  # longer words are no entries of the dictionary, so that it stays as small as its piece
_LONG_WORDS = re.compile(rb"[^ ]{%d,}" % (_LONG + 1))
_POLYNOMIAL = 0xEDB88320


def _segments(texts: pa.Array) -> Iterator[tuple[int, bytes]]:
    """``(row, words in lower case between single delimiters)``; a row longer than a piece comes in several segments, cut at delimiters."""
    data, offsets = buffers(texts)
    for row in range(len(offsets) - 1):
        at, end = int(offsets[row]), int(offsets[row + 1])
        while at < end:
            stop = min(at + PIECE, end)
            part = data[at:stop].tobytes().translate(_WORD_BYTES)
            while stop < end and (cut := part.rfind(b" ") + 1) == 0:  # inside one long word
                more = min(stop + PIECE, end)
                part, stop = part + data[stop:more].tobytes().translate(_WORD_BYTES), more
            if stop < end:
                part = part[:cut]
            yield row, part
            at += len(part)


def scan(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(end, payload)`` of every word of a delimited text, in order; a payload is ``length << 32 | crc``."""
    words = list(set(part.split()))
    loads = np.array([len(w) << 32 | zlib.crc32(w) for w in words], np.int64)
    found = np.zeros((0, 2), np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)  # these hold 32 bits: an entry keeps the place of its payload
    for i, w in enumerate(words):
        if len(w) <= _LONG:
            automaton.add_word(f" {w.decode('latin-1')} ", i)
    if len(automaton):
        automaton.make_automaton()
        found = np.fromiter(chain.from_iterable(automaton.iter(part.decode("latin-1"))), np.int64).reshape(-1, 2)
        found[:, 1] = loads[found[:, 1]]
    if max(map(len, words), default=0) > _LONG:
        far = [(m.end(), (m.end() - m.start()) << 32 | zlib.crc32(m[0])) for m in _LONG_WORDS.finditer(part)]
        found = np.concatenate([found, np.array(far, np.int64)])
        found = found[np.argsort(found[:, 0], kind="stable")]
    return found[:, 0], found[:, 1]


@cache
def _zero_bytes(power: int) -> np.ndarray:
    """What ``2 ** power`` more zero bytes make of each bit of a CRC."""
    if power:
        half = _zero_bytes(power - 1)
        return _apply(half, half)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        bits = np.where(bits & np.uint32(1), (bits >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), bits >> np.uint32(1))
    return bits


def _apply(columns: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where(crc >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


def compose(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Payloads of the texts ``left + right`` from the payloads of both."""
    crc, length = (left & 0xFFFFFFFF).astype(np.uint32), right >> 32
    for power in range(int(length.max(initial=0)).bit_length()):
        odd = (length >> power & 1).astype(bool)
        if odd.any():
            crc[odd] = _apply(_zero_bytes(power), crc[odd])
    return ((left >> 32) + length) << 32 | (crc ^ (right & 0xFFFFFFFF).astype(np.uint32)).astype(np.int64)


_SPACE = np.int64(1 << 32 | zlib.crc32(b" "))


def features(texts: pa.Array, buckets: int, run: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row of each word, row of each feature, bucket of each feature)`` for parts of the texts.

    Features are all runs of 1 to ``run`` consecutive words of a row, joined by one space; a bucket is their CRC-32 modulo ``buckets``.
    """
    tail_row, tail = -1, np.zeros(0, np.int64)  # the last words of a row that goes on in the next part

    def part(rows: list[int], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal tail_row, tail
        starts = np.cumsum([1] + [len(t) + 1 for t in texts])
        end, payload = scan(b" " + b" ".join(texts) + b" ")
        own = np.asarray(rows)[np.searchsorted(starts, end, "left") - 1] if len(end) else np.zeros(0, np.int64)
        new = own
        if run > 1 and len(tail) and rows[0] == tail_row:
            own, payload = np.concatenate([np.full(len(tail), tail_row), own]), np.concatenate([tail, payload])
        fresh = len(own) - len(new)
        row, bucket = [new], [(payload[fresh:] & 0xFFFFFFFF) % buckets]
        longer = payload
        for k in range(2, run + 1):
            if len(own) < k:
                break
            longer = compose(compose(longer[:len(own) - k + 1], np.full(len(own) - k + 1, _SPACE)), payload[k - 1:])
            inside = (own[k - 1:] == own[:len(own) - k + 1]) & (np.arange(k - 1, len(own)) >= fresh)
            row.append(own[k - 1:][inside])
            bucket.append((longer[inside] & 0xFFFFFFFF) % buckets)
        tail_row = rows[-1]
        tail = payload[own == tail_row][-(run - 1):] if run > 1 else tail
        return new, np.concatenate(row), np.concatenate(bucket)

    rows, parts, size = [], [], 0
    for row, text in _segments(texts):
        if parts and size + len(text) > PIECE:
            yield part(rows, parts)
            rows, parts, size = [], [], 0
        rows.append(row)
        parts.append(text)
        size += len(text) + 1
    if parts:
        yield part(rows, parts)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = 10000, run: int = 1) -> np.ndarray:
    """How many features of a whole table fall into each bucket: one row a bucket and task is shuffled, one a bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket in features(batch.column(0), buckets, run):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.select(F.col(text).cast("string")).mapInArrow(count, "bucket INT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both distributions, each bucket counted once more than it occurs; rounded down."""
    n = len(source)
    ratio = (target + 1.0) * (source.sum() + n) / ((source + 1.0) * (target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def importance(transcripts: DataFrame, gains: np.ndarray, key: str = "transcript_id", text: str = "text", run: int = 1) -> DataFrame:
    """key, n_words, n_features and weight of every transcript: the mean gain of its features, rounded down (none: 0)."""
    source = transcripts.select(F.col(key), F.col(text).cast("string").alias("__text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, count, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for own, row, bucket in features(batch.column(1), len(gains), run):
                np.add.at(words, own, 1)
                np.add.at(count, row, 1)
                np.add.at(total, row, gains[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(count), pa.array(total // np.maximum(count, 1))],
                                             names=[key, "n_words", "n_features", "weight"])

    return source.mapInArrow(weigh, f"`{key}` {source.dtypes[0][1]}, n_words BIGINT, n_features BIGINT, weight BIGINT")


def resample(transcripts: DataFrame, references: DataFrame, key: str = "transcript_id", text: str = "text", reference_text: str = "text",
             percent: int = 10, min_words: int = 20, buckets: int = 10000, run: int = 1, seed: str = "2024") -> DataFrame:
    """Draw the ``percent`` of the transcripts that look most like the references, by weights with Gumbel noise.

    Returns key, n_words, n_features, weight, score and rank (1 for the highest score; null where not drawn) of every
    transcript. Only transcripts with ``min_words`` words are drawn, ``floor(percent * N / 100)`` of the N there are; of equal
    scores the smaller key comes first, a null key last. The noise follows from ``seed`` and the key alone (a null key counts as an
    empty one). A null text is an empty one and has no features and weight 0; repeated rows are counted and drawn as they
    come; an empty table gives an empty one, empty references leave the weights to the transcripts' own rare words.

    All features of both tables count, in ``buckets`` numbers. A score is one of some 200,000 integers at most (gains
    below 90,000, noise from -3,131 to 22,873), so the ranks' offsets are a table of bounded size, and only rows that can be
    drawn are ordered, score by score.
    """
    gains = bucket_gains(bucket_counts(transcripts, text, buckets, run), bucket_counts(references, reference_text, buckets, run))
    weighed = importance(transcripts, gains, key, text, run)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "resampling-scores")

    able = F.col("n_words") >= min_words
    held = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("score", "descending")])
    score, n = held.column("score").to_numpy(), held.column("n").to_numpy()
    before = np.cumsum(n) - n
    drawn = percent * int(n.sum()) // 100
    lowest = int(score[before < drawn][-1]) if drawn else None
    kept = [key, "n_words", "n_features", "weight", "score"]
    rest = scored.select(*kept, F.lit(None).cast("bigint").alias("rank"))
    if lowest is None:
        return rest
    offsets = scored.sparkSession.createDataFrame(pa.table({"score": score[before < drawn], "__before": before[before < drawn]}))
    near = able & (F.col("score") >= lowest)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col(key).asc_nulls_last()))
    rank = F.col("__before") + place
    ranked = scored.filter(near).join(F.broadcast(offsets), "score").select(  # one row a score
        *kept, F.when(rank <= drawn, rank).cast("bigint").alias("rank"))
    return ranked.unionByName(rest.filter(~near))


def reference_sql(buckets: int = 10000, min_words: int = 20, percent: int = 10, seed: str = "2024") -> str:
    """The result over ``documents`` and ``benchmark`` with single words as features."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH RECURSIVE step AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS crc FROM step WHERE k = 8),
dw AS MATERIALIZED (SELECT doc_id, unnest({words}) AS w FROM documents),
bw AS MATERIALIZED (SELECT unnest({words}) AS w FROM benchmark),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
hashed AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM vocabulary, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY 1),
sizes AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
gains AS (SELECT b.bucket, floor(1000::DOUBLE * ln((coalesce(t.n, 0) + 1)::DOUBLE * (sizes.s + {buckets})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (sizes.t + {buckets})::DOUBLE))) AS gain
  FROM (SELECT unnest(range({buckets})) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sizes),
weights AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM dw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000::DOUBLE * ln(-ln(
  (('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM documents LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {min_words})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN r <= {percent} * n // 100 THEN r END AS "rank"
FROM scored LEFT JOIN ranked USING (doc_id)"""
