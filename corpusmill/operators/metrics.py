"""Statistics, agreement of scores, classification measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def metric(value: Column, prefix: str = "") -> list[Column]:
    """total, n, mean, min, max and sample variance (0 for fewer than two values). Partial sums merge in Spark's own aggregation."""
    stats = {"total": F.sum(value), "n": F.count(value), "mean": F.avg(value), "min": F.min(value), "max": F.max(value), "variance": F.coalesce(F.var_samp(value), F.lit(0.0))}
    return [c.alias(prefix + k) for k, c in stats.items()]


def top_counts(docs: DataFrame, column: Column, k: int = 20) -> DataFrame:
    """(key, value, share) of the k commonest values; null is `unknown`, ties go by key."""
    counts = docs.groupBy(F.coalesce(column.cast("string"), F.lit("unknown")).alias("key")).agg(F.count("*").alias("value"))
    total = docs.agg(F.count("*").alias("__all"))
    return counts.orderBy(F.desc("value"), "key").limit(k).crossJoin(total).select("key", "value", (F.col("value") / F.col("__all")).alias("share"))  # one row on the right


def mean_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows with the average rank of equal values. Ranks come from counts per value, so ties, however many, are one row of the window."""
    counts = rows.groupBy(value).agg(F.count("*").alias("__n"))
    ranked = counts.select(F.col(value).alias("__v"), (F.sum("__n").over(Window.orderBy(value)) - (F.col("__n") - 1) / 2).alias(out))
    return rows.join(ranked, rows[value].eqNullSafe(ranked["__v"])).drop("__v")


def agreement(rows: DataFrame, a: str, b: str, key: str, top: float = 0.1) -> DataFrame:
    """One row: spearman, pearson and the overlap of the highest `top` share (at least one row; ties by key). For evaluation samples: ranks of all distinct values are ordered in one place."""
    ranked = mean_ranks(mean_ranks(rows, a, "__ra"), b, "__rb")
    n = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") * top)).alias("__k"))
    place = lambda c: F.row_number().over(Window.orderBy(F.desc(c), key))
    both = ranked.withColumn("__pa", place(a)).withColumn("__pb", place(b)).crossJoin(n)  # one row on the right
    over = F.count_if((F.col("__pa") <= F.col("__k")) & (F.col("__pb") <= F.col("__k"))) / F.first("__k")
    return both.agg(F.corr("__ra", "__rb").alias("spearman"), F.corr(a, b).alias("pearson"), over.alias("top_overlap"), F.count("*").alias("n"))


def as_class(score: Column) -> Column:
    """Scores rounded half to even and held to 0..5."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(5.0), score.cast("double")))).cast("int")


def class_f1(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """(class, tp, predicted, actual, f1) for classes present in either."""
    pairs = rows.select(predicted.alias("p"), actual.alias("a")).groupBy("p", "a").agg(F.count("*").alias("n"))
    each = pairs.select(F.inline(F.array(F.struct(F.col("p").alias("class"), F.lit(1).alias("is_p"), "n", (F.col("p") == F.col("a")).alias("hit")), F.struct(F.col("a").alias("class"), F.lit(0).alias("is_p"), "n", F.lit(False).alias("hit")))))
    sums = each.groupBy("class").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("tp", F.col("hit")), ("predicted", F.col("is_p") == 1), ("actual", F.col("is_p") == 0))])
    return sums.withColumn("f1", 2 * F.col("tp") / (F.col("predicted") + F.col("actual")))


def evaluate(rows: DataFrame, predicted: Column, actual: Column, threshold: int = 3) -> DataFrame:
    """One row: macro_f1 over classes, binary_f1 at the threshold, and the exact share."""
    p, a = as_class(predicted), as_class(actual)
    macro = class_f1(rows, p, a).agg(F.avg("f1").alias("macro_f1"))
    yes, real = p >= threshold, a >= threshold
    both, either = F.count_if(yes & real), F.count_if(yes) + F.count_if(real)
    rest = rows.agg(F.coalesce(2 * both / F.nullif(either, F.lit(0)), F.lit(0.0)).alias("binary_f1"), (F.count_if(p == a) / F.count("*")).alias("exact"))
    return macro.crossJoin(rest)  # one row each
