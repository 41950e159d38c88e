"""Shared pieces of the operators: reading tables, durable intermediate tables, small hashing helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of a data directory, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or one of our own where it is unset and all of Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        held = tempfile.TemporaryDirectory(prefix="corpusmill-", ignore_cleanup_errors=True)
        atexit.register(held.cleanup)
        _own_dir.append(f"file://{held.name}")
    return _own_dir[0]


class Scratch:
    """Intermediate tables of one operator call, in the shared folder; they outlive executors.

    `keep` writes a frame as Parquet and reads it back, which cuts lineage. `drop` removes tables that later
    steps no longer read. Tables behind a returned frame stay; the folder's owner expires them.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/corpusmill/{label}-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        df.write.parquet(path := self.path())
        out = self.spark.read.schema(df.schema).parquet(path)
        out._corpusmill_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._corpusmill_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def as_id(df: DataFrame, name: str) -> Column:
    """An id column as it is compared and returned: integers as long, anything else as a string."""
    kind = df.select(F.col(quoted([name])[0])).schema[0].dataType
    return F.col(quoted([name])[0]).cast("long" if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "string")


def quoted(names: list[str]) -> list[str]:
    """Column names that may hold dots, for select()."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join=lambda x, y: x + y, none: int = 0) -> Column:
    """Running sums of an array (or another associative join with `none` as its neutral value), by doubling: n log n steps, where appending to an array would take n * n."""

    def of(held: Column) -> Column:
        n = F.size(held)
        steps = F.when(n > 1, F.sequence(F.lit(0), F.floor(F.log2((n - 1).cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, held, lambda a, k: F.transform(a, lambda x, i: join(x, F.coalesce(F.get(a, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(none)))))

    return let(values, of)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    return x ^ (x >> np.uint64(33))


def slices(batch, rows: int = 256) -> Iterator:
    """An Arrow batch in pieces of bounded row count."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def sized_slices(batch, column: int, size: int = 4 << 20) -> Iterator:
    """An Arrow batch in pieces whose texts in `column` have about `size` bytes at most, or a single row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    k = 0
    while k < batch.num_rows:
        n = max(1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, "right")) - k)
        yield batch.slice(k, n)
        k += n
