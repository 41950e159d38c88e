"""A streaming front end: new files of a folder go through the same steps once, however often the job restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.verdict import Step, apply_steps


def documents(spark: SparkSession, folder: str, schema: T.StructType | str, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(folder)


def drain(stream: DataFrame, steps: list[Step], out: str, checkpoint: str) -> StreamingQuery:
    """Every file not yet processed, then stop: kept and removed documents in two folders. The checkpoint is the list of finished files; batches are
    written to folders of their own number, so a batch that runs again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        verdicts = apply_steps(rows, steps)
        for name, part in (("kept", verdicts.where("drop_step is null")), ("removed", verdicts.where("drop_step is not null"))):
            part.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exact_dedup(stream: DataFrame, key: str = "text", ts: str | None = None, within: str | None = None) -> DataFrame:
    """First documents of each key. State holds a hash a key; with an event time and `within` it forgets keys older than that."""
    marked = stream.withColumn("__key", F.sha2(F.col(key).cast("string"), 256))
    if ts and within:
        return marked.withWatermark(ts, within).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
    return marked.dropDuplicates(["__key"]).drop("__key")


def start(stream: DataFrame, out: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    return shape(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
