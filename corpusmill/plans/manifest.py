"""Stages as tables: a finished stage is read back, not run again. The manifest is a small Parquet table of finished stages beside their outputs."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "stage string, status string, started double, updated double, documents long, error string"


@dataclass
class Run:
    """Stages under a folder. A stage is done once Spark's commit marker is there, so a broken write runs again."""

    spark: SparkSession
    folder: str
    resume: bool = True
    rows: list[tuple] = field(default_factory=list)

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path, began = f"{self.folder}/{name}", time.time()
        if self.resume and self._exists(f"{path}/_SUCCESS"):
            return self.spark.read.parquet(path)
        try:
            build().write.mode("overwrite").parquet(path, compression="zstd")
        except Exception:
            self._record((name, "failed", began, time.time(), None, traceback.format_exc()))
            raise
        out = self.spark.read.parquet(path)
        self._record((name, "done", began, time.time(), out.count(), None))
        return out

    def _record(self, row: tuple) -> None:
        self.rows.append(row)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/_manifest")


def status(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each stage. (Spark skips names with a leading underscore unless they are named.)"""
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/_manifest")
    last = rows.groupBy("stage").agg(F.max_by(F.struct("status", "started", "updated", "documents", "error"), "updated").alias("s"))
    return last.select("stage", "s.*").orderBy("started")


def estimate_eta(done: list[float], running: list[tuple[float, float]], waiting: int, workers: int) -> float | None:
    """Seconds left: the longest rest of the running tasks (elapsed, share done), then waves of waiting ones at the mean time. None before anything is known."""
    known = done + [t / share for t, share in running if share > 0]
    if not known:
        return None
    mean = sum(known) / len(known)
    rest = max([t / share - t if share > 0 else max(0.0, mean - t) for t, share in running], default=0.0)
    return rest + -(-waiting // max(1, workers)) * mean


def duration(seconds: float) -> str:
    whole = round(seconds)
    if whole >= 3600:
        return f"{whole // 3600}h{whole // 60 % 60:02d}m"
    return f"{whole // 60}m{whole % 60:02d}s" if whole >= 60 else f"{whole}s"


def render_status(rows: list) -> str:
    lines = [f"{r['stage']:<24} {r['status']:<8} {duration(r['updated'] - r['started']):>8} {r['documents'] if r['documents'] is not None else '-':>12}" for r in rows]
    errors = [f"{r['stage']}: {r['error'].strip().splitlines()[-1]}" for r in rows if r["error"]]
    return "\n".join(lines + errors)
