"""Intermediate tables of this subpackage in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aetherlog.plans.store import stored as _stored


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: a lost executor costs a re-read."""
    return _stored(df, purpose)


def text_bytes(df: DataFrame, *columns: str) -> int:
    """Total bytes of some string or binary columns, by one aggregation."""
    total = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in columns), F.lit(0).cast("bigint"))
    return df.select(F.sum(total).alias("n")).first()["n"] or 0
