"""Late rows as a side output: every row comes out, with a mark if it is late, and nothing vanishes unseen.

Spark's own watermark drops late rows before an operator can see them. Here each key keeps the newest event time of its earlier
batches; a row that is more than ``late_s`` behind it is late. Operators with a watermark of ``late_s`` then take the rest, and the late
ones go to a table of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aetherlog.functions.display import micros

LATE, BEHIND = "late", "behind_s"


class Lateness(StatefulProcessor):
    """One number per key: the newest event time of the batches before. A row without a time is late."""

    def __init__(self, late_us: int, columns: list[str]):
        self.late, self.columns = late_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.newest.get()[0] if self.newest.exists() else None
        newest = before
        for pdf in rows:  # a part of the batch at a time
            us = pdf["lateness_us"]
            if us.notna().any():
                top = int(us.max())
                newest = top if newest is None else max(newest, top)
            behind = (before - us) / 1e6 if before is not None else us * 0.0
            out = pdf[self.columns].copy()
            out[LATE] = (behind > self.late / 1e6) | us.isna()
            out[BEHIND] = behind.clip(lower=0)
            yield out
        if newest is not None:
            self.newest.update((newest,))

    def close(self) -> None:
        pass


def mark_late(rows: DataFrame, key: list[str], late_s: int, ts: str = "ts") -> DataFrame:
    """All rows of a stream with ``late`` and ``behind_s``, the seconds behind the newest row of the key's earlier batches (0 if ahead).

    Rows of one batch do not make each other late, in whatever order they come. A null time is late. State is one number per key.
    """
    schema = T.StructType([*rows.schema, T.StructField(LATE, T.BooleanType()), T.StructField(BEHIND, T.DoubleType())])
    timed = rows.withColumn("lateness_us", micros(ts).cast("double"))
    return timed.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=Lateness(late_s * 1000000, rows.columns), outputStructType=schema, outputMode="Append", timeMode="None")


def split_handler(path: str):
    """Handler of marked rows: both kinds to folders of their own, ``rows`` and ``late``; a batch that is tried again overwrites its own."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()  # the marks are worked out once
        kept.filter(~F.col(LATE)).drop(LATE, BEHIND).write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
        kept.filter(F.col(LATE)).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        kept.unpersist()

    return on_batch
