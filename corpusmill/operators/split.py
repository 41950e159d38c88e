"""Hold-out, selections, samples and shuffles that don't depend on partitions: a hash of the row decides."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import text as T
from ..functions.text import hash64


FRACTION, SALT = 0.001, "holdout"


def in_holdout(text: Column, fraction: float = FRACTION, salt: str = SALT, native: bool = False) -> Column:
    """Whether the hash of salt and text is in the lowest `fraction`. native: MD5 on the JVM side in place of BLAKE2b."""
    if fraction < 0 or fraction > 1:
        raise ValueError(f"fraction {fraction} isn't between 0 and 1")
    limit = int(fraction * 2**64)
    if native:
        return T.md5_64(F.concat(F.lit(f"{salt}|"), text)) < F.lit(limit).cast("decimal(20,0)")

    @F.pandas_udf("boolean")
    def low(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash64(salt + "\0" + t) < limit, na_action="ignore").astype("boolean")

    return low(text)


def holdout_split(docs: DataFrame, fraction: float = FRACTION, salt: str = SALT, text: str = "text", native: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, held out). A null text is kept."""
    marked = docs.withColumn("__held", F.coalesce(in_holdout(F.col(text), fraction, salt, native), F.lit(False)))
    return marked.where("not __held").drop("__held"), marked.where("__held").drop("__held")


def select(docs: DataFrame, reason: str = "", grep: str = "", domain: str = "", text: str = "text", url: str = "url") -> DataFrame:
    """By exact filter reason, end of the host, and regular expression in the text."""
    if reason:
        docs = docs.where(F.col("filter_reason") == reason)
    if domain:
        docs = docs.where(T.host_of(F.col(url)).endswith(domain))
    if grep:
        re.compile(grep)
        docs = docs.where(F.col(text).rlike(grep))
    return docs


def sample(docs: DataFrame, size: int, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """The `size` rows with the lowest hashes of seed and key."""
    return docs.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")), F.col(key)).limit(size)


def shuffle(docs: DataFrame, seed: int = 0, key: str = "doc_id") -> DataFrame:
    return docs.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")), F.col(key))


def spread(rows: DataFrame, count: int, total: int, order: str) -> DataFrame:
    """`count` of a listing's `total` rows, evenly spaced in order; for listings of files, which fit one task."""
    at = F.row_number().over(Window.orderBy(order)) - 1
    step = max(1, total // max(1, count))
    return rows.withColumn("__at", at).where((F.col("__at") % step == 0) & (F.floor(F.col("__at") / step) < count)).drop("__at")


def stratified_split(rows: DataFrame, stratum: str, key: str, seed: int = 42, test: float = 0.1) -> DataFrame:
    """rows with `is_test`: in each stratum the round(n * test) rows with the lowest hashes.

    Ranks within a stratum come from counts of hash ranges, so that a stratum with most rows isn't one task: a row's rank is the rows of lower ranges plus its rank in its own."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))
    rows = rows.withColumn("__h", h).withColumn("__bin", F.substring(h, 1, 3))
    sizes = rows.groupBy(stratum, "__bin").agg(F.count("*").alias("__n"))
    all_of, up_to = Window.partitionBy(stratum), Window.partitionBy(stratum).orderBy("__bin")
    bins = sizes.select(F.col(stratum).alias("__s"), F.col("__bin").alias("__b"), (F.sum("__n").over(up_to) - F.col("__n")).alias("__before"), F.sum("__n").over(all_of).alias("__all"))
    joined = rows.join(bins, rows[stratum].eqNullSafe(bins["__s"]) & (rows["__bin"] == bins["__b"]))
    rank = F.row_number().over(Window.partitionBy(stratum, "__bin").orderBy("__h", key)) + F.col("__before")
    return joined.withColumn("is_test", rank <= F.bround(F.col("__all") * F.lit(test))).drop("__h", "__bin", "__s", "__b", "__before", "__all")
