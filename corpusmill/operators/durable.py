"""Intermediate tables in the shared folder; they survive lost executors and cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and all of Spark is one process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        held = tempfile.TemporaryDirectory(prefix="corpusmill-", ignore_cleanup_errors=True)
        atexit.register(held.cleanup)
        _own.append(f"file://{held.name}")
    return _own[0]


def keep(df: DataFrame) -> DataFrame:
    """The frame, written as Parquet and read again."""
    path = f"{shared_dir(df.sparkSession)}/corpusmill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
