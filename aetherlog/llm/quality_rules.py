"""Quality rules for transcripts with thresholds learned per language and stream.

Fixed cutoffs reject whole languages or stations whose normal texts merely look unusual. Here each
measure's cutoff is a fence above the quartiles of its own stratum, read from mergeable quantile
sketches: every task sketches the rows it has, sketches of a stratum merge, the sketches of a
language's streams merge again into one for streams with few transcripts, and all of them into
one for rare languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aetherlog.llm.chunks import repeated, text_pieces

SYMBOLS = b"#*$%&|<>"
MEASURES = ("symbol_share", "dup_line_share", "repeat_share", "word_length")
#: Least width of a fence above the upper quartile, per measure: what is never taken for an outlier.
SLACK = {"symbol_share": 0.05, "dup_line_share": 0.75, "repeat_share": 0.20, "word_length": 4.0}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(texts: pa.Array) -> dict[str, np.ndarray]:
    out = {c: np.zeros(len(texts), np.int64) for c in _COUNTS}
    for a, b, piece in text_pieces(texts):
        starts, ends, first = piece.words()
        row = piece.row_of(starts)
        out["n_words"][a:b] = np.diff(first)
        heads = (piece.data & 0xC0) != 0x80
        inside = np.zeros(len(piece.data) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        out["word_chars"][a:b] = piece.per_row(heads & (np.cumsum(inside[:-1]) > 0))
        out["n_symbols"][a:b] = piece.per_row(_SYMBOL[piece.data])

        # words covered by a three-word window that the same text has twice
        if len(starts) > 2:
            w = piece.spans(starts, ends)
            key = w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(0x9E3779B97F4A7C15) + w[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= row[:-2].astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
            whole = row[:-2] == row[2:]
            hit = np.zeros(len(starts), bool)
            hit[:-2][whole] = repeated(key[whole])
            covered = hit.copy()
            covered[1:] |= hit[:-1]
            covered[2:] |= hit[:-2]
            out["n_repeat_words"][a:b] = np.bincount(row[covered], minlength=b - a)

        # lines with a word that equal an earlier line of the same text
        ls, le = piece.lines()
        spoken = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
        ls, le = ls[spoken], le[spoken]
        lrow = piece.row_of(ls)
        lkey = piece.spans(ls, le) ^ (lrow.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
        _, once = np.unique(lkey, return_index=True)
        out["n_dup_lines"][a:b] = np.bincount(lrow, minlength=b - a) - np.bincount(lrow[once], minlength=b - a)
    return out


def text_measures(transcripts: DataFrame, key: str = "transcript_id", text: str = "text",
                  keep: tuple[str, ...] = ("language", "stream_id")) -> DataFrame:
    """Counts of every whole text: one row per input row with ``key``, the kept columns and the counts.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``word_chars``: code points in words. ``n_symbols``: characters of
    ``#*$%&|<>``. ``n_dup_lines``: lines with a word that equal an earlier line of the text.
    ``n_repeat_words``: words lying in a three-word window that the text has at least twice.
    A null text counts as an empty one: all counts 0.
    """
    columns = [key, *keep]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _measure(batch.column(len(columns)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(columns)], *(pa.array(counts[c]) for c in _COUNTS)], names=[*columns, *_COUNTS])

    source = transcripts.select(*columns, F.col(text).cast("string").alias("__text"))
    fields = ", ".join([*(f"`{c}` {t}" for c, t in source.dtypes[:-1]), *(f"{c} BIGINT" for c in _COUNTS)])
    return source.mapInArrow(measure, fields)


def with_verdict(measured: DataFrame, language: str = "language", stream: str = "stream_id", min_words: int = 50,
                 max_repeat_percent: int = 50, fence: float = 3.0, min_stratum: int = 200, sketch_k: int = 400) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to the rows of :func:`text_measures`.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of them repeated.
    A text that passes is kept unless one of its shares lies above its stratum's fence
    ``q75 + max(fence * (q75 - q25), SLACK)``. The sketches take the texts that pass the base rules only,
    all of them. A stratum (language, stream) with fewer than ``min_stratum`` such texts uses the
    sketch of its language, a language with fewer the sketch of all. Null languages and streams form
    strata of their own. An empty table gives an empty table.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    shares = {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / n, "repeat_share": F.col("n_repeat_words") / n,
        "word_length": F.col("word_chars") / n,
    }
    # lines are counted against words: 30 words a line make a duplicated share of 1/30 a full one
    shares["dup_line_share"] = shares["dup_line_share"] * 30
    base = measured.withColumn("base_failed", (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    passed = base.filter(~F.col("base_failed")).select(
        F.col(language).alias("__l"), F.col(stream).alias("__s"), *(shares[m].alias(m) for m in MEASURES))

    own = passed.groupBy("__l", "__s").agg(
        F.count("*").alias("n"), *(F.kll_sketch_agg_double(m, F.lit(sketch_k)).alias(m) for m in MEASURES))

    def merged(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(m).alias(m) for m in MEASURES))

    def fences(df: DataFrame, name: str) -> DataFrame:
        def edge(m: str):
            q25, q75 = (F.kll_sketch_get_quantile_double(m, F.lit(q)) for q in (0.25, 0.75))
            return q75 + F.greatest(fence * (q75 - q25), F.lit(SLACK[m]))
        keys = [c for c in ("__l", "__s") if c in df.columns]
        return df.select(*keys, F.struct("n", *(edge(m).alias(m) for m in MEASURES)).alias(name))

    by_language = merged(own, "__l")
    everything = merged(by_language.withColumn("__all", F.lit(1)), "__all")  # no row for no texts
    own_f, language_f = fences(own, "own"), fences(by_language, "lang")
    overall = fences(everything, "any").first()  # one row of five numbers
    everyone = F.lit(None).cast(own_f.schema["own"].dataType) if overall is None else F.struct(
        *(F.lit(v).alias(k) for k, v in overall["any"].asDict().items()))
    # one row per stratum: the sketch that stands for it
    language_f = language_f.withColumnRenamed("__l", "__ll")
    table = own_f.join(language_f, F.col("__l").eqNullSafe(F.col("__ll")), "left").select(
        F.col("__l"), F.col("__s"),
        F.when(F.col("own.n") >= min_stratum, F.col("own")).when(F.col("lang.n") >= min_stratum, F.col("lang"))
        .otherwise(everyone).alias("__fence"))
    joined = base.join(table, F.col(language).eqNullSafe(F.col("__l")) & F.col(stream).eqNullSafe(F.col("__s")), "left")
    usual = F.lit(True)
    for m in MEASURES:
        usual = usual & (shares[m] <= F.col(f"__fence.{m}"))
    kept = ~F.col("base_failed") & F.coalesce(usual, F.lit(True))
    return joined.withColumn("kept", kept).drop("__l", "__s", "__fence")


def quality_rules(transcripts: DataFrame, key: str = "transcript_id", text: str = "text", language: str = "language",
                  stream: str = "stream_id", **limits) -> DataFrame:
    """One row per transcript: its counts, ``base_failed`` and ``kept`` (see :func:`with_verdict`).

    Takes every row and every whole text; only counts are shuffled. Equal rows stay equal rows.
    Columns besides the four named ones are ignored, whatever their names.
    """
    from aetherlog.llm.shared import stored

    measured = text_measures(transcripts, key, text, (language, stream))
    return with_verdict(stored(measured, "quality-rules"), language, stream, **limits)
