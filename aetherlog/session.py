"""Session helpers: a local session for tests and benchmarks, and shared folders."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A small local session; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("aetherlog")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .getOrCreate()
    )


def session_with(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session of the same application with all settings of this one, but for those given, which so hold only for tables made with it."""
    out = spark.newSession()
    for k, v in {**spark.conf.getAll, **settings}.items():
        if spark.conf.isModifiable(k):
            out.conf.set(k, v)
    return out


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="aetherlog-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder: on a cluster the executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
