"""Intermediate tables that more than one branch of a plan reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aetherlog.session import shared_folder


def stored(df: DataFrame, purpose: str, session: SparkSession | None = None) -> DataFrame:
    """Write a table to the shared folder once and read it back.

    Worth it when several branches need the same costly rows: each branch then
    scans only the columns it needs, and a lost executor costs a re-read.
    With a ``session`` the table returned is one of that session.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)
