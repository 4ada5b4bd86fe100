"""Repeated passages of whole lines: windows of lines that meet by hashes of the whole window.

The main path uses DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aetherlog.llm.shared import stored

BREAK = "\n"
_BLANKS = " \t\r\x0b\x0c"


def spoken_lines(transcripts: DataFrame, key: str = "transcript_id", text: str = "text") -> DataFrame:
    """The lines with at least one word: key, digest (of the text), pos, words, line (two hashes of it without outer blanks)."""
    body = transcripts.filter(F.length(text) > 0).select(
        F.col(key).alias("key"), F.xxhash64(text).alias("digest"), F.posexplode(F.split(text, BREAK)).alias("pos", "line"))
    body = body.withColumn("line", F.btrim("line", F.lit(_BLANKS))).filter(F.length("line") > 0)
    return body.select("key", "digest", "pos", F.size(F.split("line", "[\\x20\\x09-\\x0D]+")).alias("words"),
                       F.struct(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).alias("line"))


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """For each line the shortest window of ``min_words`` words that begins, and that ends, with it.

    Returns key, digest, first and last (positions), seed (the window's smallest line hash),
    ahead and behind (hashes of the lines on both sides of it); the three stand for the whole window, and none is left out. A run of
    ``min_words`` words is the union of such windows, so two equal runs share the hashes of each of them.
    """
    doc = Window.partitionBy("key", "digest").orderBy("pos")
    twin = F.lag("pos").over(doc)  # a repeated row brings every line twice
    lines = lines.withColumn("twin", twin).filter(F.col("twin").isNull() | (F.col("twin") != F.col("pos")))
    lines = lines.withColumn("upto", F.sum("words").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.select("key", "digest", "upto", (F.col("upto") - F.col("words")).alias("before"),
                         F.struct("line", "pos").alias("at"))
    onward = Window.partitionBy("key", "digest").orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("key", "digest").orderBy("upto").rangeBetween(1 - min_words, 0)
    lines = lines.select(
        "key", "digest",
        F.when(F.max("upto").over(onward) - F.col("before") >= min_words, F.collect_list("at").over(onward)).alias("onward"),
        F.when(F.col("upto") - F.min("before").over(back) >= min_words, F.collect_list("at").over(back)).alias("back"))
    whole = lines.select("key", "digest", F.explode(F.array("onward", "back")).alias("w")).filter(F.col("w").isNotNull())
    seed = F.array_min("w")
    whole = whole.select("key", "digest", F.element_at("w", 1)["pos"].alias("first"), F.element_at("w", -1)["pos"].alias("last"),
                         "w", seed.alias("s"))

    def part(side):
        return F.xxhash64(F.transform(F.filter("w", side), lambda x: x["line"]))
    return whole.select("key", "digest", "first", "last", F.col("s.line").alias("seed"),
                        part(lambda x: x["pos"] < F.col("s.pos")).alias("ahead"),
                        part(lambda x: x["pos"] > F.col("s.pos")).alias("behind"))


def repeated_runs(transcripts: DataFrame, key: str = "transcript_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """Runs of lines that repeat earlier ones: key, digest, runs (array of first and last position).

    Occurrences meet by the hashes of their whole window; the first one, by key and
    position, is kept, and every later one that does not overlap it is a repeat. Overlapping repeats form one run.
    No pair of occurrences is ever made: a passage that a third of all transcripts share costs one row per occurrence.
    """
    found = stored(windows(spoken_lines(transcripts, key, text), min_words), "line-windows")
    identity = ["seed", "ahead", "behind"]
    firsts = found.groupBy(*identity).agg(
        F.min(F.struct("key", "digest", "first", "last")).alias("origin"), F.count("*").alias("n"))
    later = found.join(firsts.filter("n > 1"), identity).filter(
        ~(F.col("key").eqNullSafe(F.col("origin.key")) & (F.col("digest") == F.col("origin.digest"))
          & (F.col("first") <= F.col("origin.last"))))
    doc = Window.partitionBy("key", "digest").orderBy("first", "last")
    edge = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.select("key", "digest", "first", "last", edge.alias("edge")).withColumn(
        "run", F.sum(F.when(F.col("edge").isNull() | (F.col("first") > F.col("edge") + 1), 1).otherwise(0)).over(
            doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "digest", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("key", "digest").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(transcripts: DataFrame, key: str = "transcript_id", text: str = "text", keep: tuple[str, ...] = (),
                min_words: int = 50) -> DataFrame:
    """Delete later copies of every run of whole lines with ``min_words`` words or more.

    Returns key, the columns named in ``keep``, the text without the repeated runs, n_lines, n_removed (lines deleted, blank ones inside a
    run included) and n_runs. Lines are compared without outer blanks; lines without words neither join nor part a run.
    The first copy, by key and position, stays. A text without repeats is returned as it is, null included (n_lines 0).
    Rows with equal key and text are one transcript and get one result each; an empty table gives an empty one.
    """
    runs = repeated_runs(transcripts, key, text, min_words).select(
        F.col("key").alias("__key"), F.col("digest").alias("__digest"), F.col("runs").alias("__runs"))
    body = transcripts.select(F.col(key), *keep, F.col(text)).withColumn("__own", F.xxhash64(text))
    joined = body.join(runs, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__digest")), "left")
    lines = F.split(text, BREAK)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.exists("__runs", lambda r: i.between(r["first"], r["last"]))), BREAK)
    gone = F.aggregate("__runs", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1)
    return joined.select(
        key, *keep, F.when(F.col("__runs").isNull(), F.col(text)).otherwise(left).alias(text),
        F.when(F.length(text) > 0, F.size(lines)).otherwise(0).cast("bigint").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.size("__runs"), F.lit(0)).cast("bigint").alias("n_runs"))


def reference_sql(min_words: int = 50) -> str:
    """The same result from plain SQL over ``documents``: every window's text is compared as it is."""
    space = "[\\x20\\x09-\\x0D]+"
    blanks = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE length(text) > 0),
spoken AS (SELECT doc_id, pos, trim(line, {blanks}) AS line FROM cut WHERE length(trim(line, {blanks})) > 0),
counted AS (SELECT *, len(string_split_regex(line, '{space}')) AS words FROM spoken),
placed AS (
  SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS upto,
    CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) - words AS before FROM counted),
win AS (
  SELECT a.doc_id, min(b.pos) AS first, max(b.pos) AS last, string_agg(b.line, chr(10) ORDER BY b.pos) AS body
  FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.before BETWEEN a.before AND a.before + {min_words - 1}
  GROUP BY a.doc_id, a.pos HAVING max(b.upto) - min(b.before) >= {min_words}
  UNION
  SELECT a.doc_id, min(b.pos), max(b.pos), string_agg(b.line, chr(10) ORDER BY b.pos)
  FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.upto BETWEEN a.upto - {min_words - 1} AND a.upto
  GROUP BY a.doc_id, a.pos HAVING max(b.upto) - min(b.before) >= {min_words}),
origin AS (SELECT body, min(struct_pack(doc_id := doc_id, first := first, last := last)) AS o FROM win GROUP BY body),
later AS (
  SELECT DISTINCT w.doc_id, w.first, w.last FROM win w JOIN origin g USING (body)
  WHERE NOT (w.doc_id = g.o.doc_id AND w.first <= g.o.last)),
gone AS (SELECT DISTINCT c.doc_id, c.pos FROM cut c JOIN later l ON c.doc_id = l.doc_id AND c.pos BETWEEN l.first AND l.last),
runs AS (
  SELECT doc_id, count(*) AS n_removed, sum(starts) AS n_runs FROM (
    SELECT doc_id, pos, CASE WHEN lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) = pos - 1 THEN 0 ELSE 1 END AS starts FROM gone)
  GROUP BY doc_id),
kept AS (
  SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.pos) AS text
  FROM cut c ANTI JOIN gone g ON c.doc_id = g.doc_id AND c.pos = g.pos GROUP BY c.doc_id)
SELECT d.doc_id, CAST(CASE WHEN length(d.text) > 0 THEN len(string_split(d.text, chr(10))) ELSE 0 END AS BIGINT) AS n_lines,
  CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.n_runs, 0) AS BIGINT) AS n_runs,
  md5(CASE WHEN r.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END) AS text_md5
FROM documents d LEFT JOIN runs r ON d.doc_id = r.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id"""
