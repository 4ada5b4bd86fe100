"""Readers. Each returns one table; batch and streaming share the transformation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aetherlog import dims, schemas
from aetherlog.functions.text import strip_ws
from aetherlog.plans.store import stored
from aetherlog.sources import recordings


# --- audio -------------------------------------------------------------------------------

def pcm_chunks(recordings: DataFrame, content: str = "content", chunk_bytes: int = dims.CHUNK_BYTES) -> DataFrame:
    """Cut recorded bytes into fixed-size chunks in order; the last may be short."""
    last = F.floor((F.length(content) - 1) / chunk_bytes).cast("bigint")
    rest = [c for c in recordings.columns if c != content]
    cut = recordings.filter(F.length(content) > 0).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    piece = F.substring(F.col(content), (F.col("seq") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    return cut.select(*rest, "seq", piece.alias("pcm"))


def read_pcm(spark: SparkSession, path: str, chunk_bytes: int = dims.CHUNK_BYTES, streaming: bool = False,
             block_bytes: int = recordings.BLOCK_BYTES, max_bytes_per_trigger: int | None = None, quiet_s: float = 60) -> DataFrame:
    """Chunks ``(stream_id, ts, seq, pcm)`` of raw 16-bit mono recordings; one file is one stream, of any size.

    A file is read in ranges of ``block_bytes``, a task each. A stream follows growing files: whole chunks at once, the short
    one at the end after ``quiet_s`` seconds; a recording that goes on after that sends its last chunk again. Nothing is dropped.
    """
    spark.dataSource.register(recordings.PcmRecordings)
    reader = (spark.readStream if streaming else spark.read).format(recordings.FORMAT)
    reader = reader.option("chunkBytes", chunk_bytes).option("blockBytes", block_bytes)
    if streaming:
        reader = reader.option("quietSeconds", quiet_s).option("maxBytesPerTrigger", max_bytes_per_trigger or 0)
    return reader.load(path)


# --- text --------------------------------------------------------------------------------

def frame_lines(raw: DataFrame, value: str = "value") -> DataFrame:
    """Newline framing: split, strip, drop blanks. Undecodable bytes are already replaced."""
    rest = [c for c in raw.columns if c != value]
    lines = raw.select(*rest, F.posexplode(F.split(F.col(value), "\n")).alias("line_no", "value"))
    return lines.withColumn("value", strip_ws("value")).filter(F.length("value") > 0)


def telemetry_time(value: str | Column, received: str | Column) -> Column:
    """When a telemetry line was made: its own date and time fields, else when it was received."""
    f = F.split(value, ",")
    own = F.try_to_timestamp(F.concat_ws(" ", F.trim(F.get(f, F.lit(6))), F.trim(F.get(f, F.lit(7)))), F.lit("yyyy/MM/dd HH:mm:ss[.SSS]"))
    return F.coalesce(own, F.col(received) if isinstance(received, str) else received)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``(value, seq, received_at, file)`` of text files; ``seq`` is the line's number in its file, blank lines counted.

    A file is split among tasks. Each split knows where it begins and its lines' order, so the lines are written once as
    they are read, counted per split, and numbered from the counts of the splits before. No file is sorted or in one task.
    """
    at = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(path).select(
        "value", at["file_path"].alias("file"), at["file_modification_time"].alias("received_at"),
        at["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"))
    rows = stored(raw, "lines")
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per split
    return rows.join(splits, ["file", "split"]).select(
        "value", (F.col("base") + F.col("at") - F.col("first")).alias("seq"), "received_at", "file")


def read_sbs(spark: SparkSession, path: str, streaming: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """Telemetry lines ``(value, ts, seq, file)`` from text files (or a stream of them), ready for ``parse_sbs``.

    ``seq`` is the line's number in its file. In batch a file may have any size, see :func:`numbered_lines`. A stream takes each
    file, which a station has closed by then, as one row, so that its lines can be numbered without state.
    """
    if streaming:
        reader = spark.readStream
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        files = reader.format("text").option("wholetext", True).schema("value STRING").load(path).select(
            "value", F.col("_metadata.file_modification_time").alias("received_at"), F.col("_metadata.file_path").alias("file"))
        lines = frame_lines(files).withColumnRenamed("line_no", "seq")
    else:
        lines = numbered_lines(spark, path).withColumn("value", strip_ws("value")).filter(F.length("value") > 0)
    return lines.select("value", telemetry_time("value", "received_at").alias("ts"), F.col("seq").cast("bigint").alias("seq"), "file")


def newest_per(df: DataFrame, key: list[str], age: str | Column) -> DataFrame:
    """Newest copy per key."""
    age = F.col(age) if isinstance(age, str) else age
    rest = [c for c in df.columns if c not in key]
    newest = df.groupBy(*key).agg(F.max_by(F.struct(*rest), age).alias("r"))
    return newest.select(*key, "r.*")


def read_tle(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines of the newest element file, so a cached copy serves when no newer one came.

    The newest one is found by the listing alone; only that file is read. A catalogue file is a few
    megabytes at most, hence one row.
    """
    listed = spark.read.format("binaryFile").load(paths).select("path", "modificationTime")
    newest = listed.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()["path"]
    if newest is None:
        return spark.createDataFrame([], "file STRING, line_no INT, value STRING")
    text = spark.read.text(newest, wholetext=True).select(F.lit(newest).alias("file"), "value")
    return frame_lines(text)


# --- dimensions ------------------------------------------------------------------------------

def _dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table as a local relation: Spark knows its size and broadcasts it by itself."""
    types = {"STRING": pa.string(), "INT": pa.int32()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = [pa.array(list(values), types[t]) for values, (_, t) in zip(zip(*rows), fields)]
    return spark.createDataFrame(pa.table(columns, names=[n for n, _ in fields]))


def presets(spark: SparkSession) -> DataFrame:
    return _dimension(spark, dims.PRESETS, schemas.PRESETS)


def categories(spark: SparkSession) -> DataFrame:
    rows = [(c, i, label) for i, (c, label) in enumerate(dims.CATEGORIES)]
    return _dimension(spark, rows, schemas.CATEGORIES)


# --- images and tables -------------------------------------------------------------------------

def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the ``*.png`` files in a folder; their content is never read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path")


def transcripts(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schemas.TRANSCRIPTS).parquet(path)


def union_sources(**named: DataFrame) -> DataFrame:
    """One table from interchangeable inputs; ``source`` tells where a row came from."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in named.items()]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
