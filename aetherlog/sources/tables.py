"""Tables that a stream keeps current: a pointer names the folders that count, and is moved last.

A batch writes its folders first. They become visible together when the pointer, one small file, is put in place; a batch
that dies before that leaves nothing that a reader sees, and one that is tried again overwrites its own folders. Readers that began before
go on with the folders of their pointer.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aetherlog.operators.metrics import latest

BUCKETS = 64


@dataclass(frozen=True)
class Pointer:
    """What a table consists of: the newest batch in it and the folder of each of its parts."""

    version: int = 0
    batch_id: int = -1
    parts: dict[str, str] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _files(spark, path)
    folder = at(f"{path}/pointers")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def pointer(spark: SparkSession, path: str, version: int | None = None) -> Pointer:
    """The newest pointer of a table, or that of a version; an empty one if there is none."""
    if version is None:
        version = max(_versions(spark, path), default=0)
    if not version:
        return Pointer()
    body = spark.read.text(f"{path}/pointers/{version}.json", wholetext=True).first()[0]
    return Pointer(**json.loads(body))


def _move(spark: SparkSession, path: str, to: Pointer) -> None:
    """Put a pointer in place under its own version. Written beside it first, so that no reader meets half of it."""
    fs, at = _files(spark, path)
    draft, final = at(f"{path}/pointers/_{to.version}.draft"), at(f"{path}/pointers/{to.version}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(asdict(to)).encode()))
    out.close()
    if not fs.rename(draft, final):
        raise RuntimeError(f"{final} is there already: two writers on one table")


def upsert(batch: DataFrame, path: str, key: list[str], order: list[str], batch_id: int, buckets: int = BUCKETS) -> Pointer:
    """Merge the rows of a batch into a table of the newest row per key.

    Keys are dealt to buckets by their hash; only buckets that the batch has keys of are read and written again. A batch that
    is in the table already changes nothing, so a retry is safe. Rows older than the table's do not replace them. The numbers of
    touched buckets, at most ``buckets``, are all that reaches the driver.
    """
    spark = batch.sparkSession
    before = pointer(spark, path)
    if batch_id <= before.batch_id:
        return before
    new = latest(batch, key, order).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
    touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]
    old = [before.parts[b] for b in touched if b in before.parts]
    rows = new
    if old:
        held = spark.read.schema(batch.schema).parquet(*old)
        rows = rows.unionByName(held.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
        rows = latest(rows, ["bucket", *key], order)
    folder = f"{path}/rows/{before.version + 1}"
    rows.select(*batch.columns, "bucket").repartition(max(len(touched), 1), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    new.unpersist()
    after = Pointer(before.version + 1, batch_id, {**before.parts, **{b: f"{folder}/bucket={b}" for b in touched}})
    _move(spark, path, after)
    return after


def upsert_handler(path: str, key: list[str], order: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Handler of a stream that keeps a table current; start it with ``feeds.start``."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, path, key, order, batch_id, buckets)

    return on_batch


def current(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a table as its pointer, or that of an earlier version, has them; no rows before the first batch."""
    parts = list(pointer(spark, path, version).parts.values())
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*parts)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete pointers older than the last ``keep`` and the folders that only they named; returns how many folders went."""
    versions = _versions(spark, path)
    fs, at = _files(spark, path)
    gone, stay = versions[:-keep], {p for v in versions[-keep:] for p in pointer(spark, path, v).parts.values()}
    dead = {p for v in gone for p in pointer(spark, path, v).parts.values()} - stay
    for p in sorted(dead):
        fs.delete(at(p), True)
    for v in gone:
        fs.delete(at(f"{path}/pointers/{v}.json"), False)
    return len(dead)
