"""Rule chains: every document ends with the first step that dropped it and that step's first reason, or with neither."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import strip
from .durable import keep


def first_reason(rules: list[tuple[str, Column | None]]) -> Column:
    """The name of the first rule whose condition holds, or null. A rule with no condition is switched off."""
    out = None
    for reason, condition in rules:
        if condition is not None:
            out = F.when(condition, reason) if out is None else out.when(condition, reason)
    return F.lit(None).cast("string") if out is None else out


@dataclass(frozen=True)
class Step:
    """A named step. `reason` gives a document's reason to go (null: it stays); `rewrite` gives the new text of those that stay; after a
    formatter a text that is blank goes (reason dropped_empty). A reason that runs Python reads the column ALIVE_TEXT, which is null for documents that went before."""

    name: str
    reason: Callable[[DataFrame], Column] | None = None
    rewrite: Callable[[Column], Column] | None = None
    formatter: bool = False
    python: bool = False


ALIVE_TEXT = "__alive_text"


def apply_steps(docs: DataFrame, steps: list[Step], text_col: str = "text") -> DataFrame:
    """docs with drop_step and drop_reason (null for kept documents) and the rewritten text; dropped documents keep the text they had. Verdicts that docs already has go on."""
    out = docs
    for name in ("drop_step", "drop_reason"):
        if name not in docs.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    for step in steps:
        alive = F.col("drop_step").isNull()
        if step.reason is not None:
            if step.python:
                # A condition that isn't deterministic keeps the optimizer from moving the conditions, with their lambdas, into the arguments of a Python function, where Spark can't evaluate them.
                out = out.withColumn(ALIVE_TEXT, F.when(alive & (F.spark_partition_id() >= 0), F.col(text_col)))
            out = out.withColumn("__reason", F.when(alive, step.reason(out))).drop(ALIVE_TEXT)
            out = out.withColumn("drop_step", F.when(alive & F.col("__reason").isNotNull(), step.name).otherwise(F.col("drop_step")))
            out = out.withColumn("drop_reason", F.coalesce("drop_reason", "__reason")).drop("__reason")
            alive = F.col("drop_step").isNull()
        if step.rewrite is not None:
            out = out.withColumn(text_col, F.when(alive, step.rewrite(F.col(text_col))).otherwise(F.col(text_col)))
            if step.formatter:
                gone = alive & (strip(F.col(text_col)) == "")
                out = out.withColumn("drop_reason", F.when(gone, "dropped_empty").otherwise(F.col("drop_reason"))).withColumn("drop_step", F.when(gone, step.name).otherwise(F.col("drop_step")))
    return out


def kept(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("drop_step is null").drop("drop_step", "drop_reason")


def removed(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("drop_step is not null").withColumnsRenamed({"drop_step": "step", "drop_reason": "filter_reason"})


def funnel(verdicts: DataFrame, steps: list[str]) -> DataFrame:
    """(position, step, label, value, share): each step's total, forwarded and dropped documents, then its reasons. One aggregation over the documents; the rest
    works on its few rows."""
    # A table: each of the branches below would work out the verdicts again, with filters of its own.
    counts = keep(verdicts.groupBy("drop_step", "drop_reason").agg(F.count("*").alias("n")))
    spark = verdicts.sparkSession
    named = spark.createDataFrame(list(enumerate(steps)), "position int, step string")
    order = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)  # a row for each step
    of_step = counts.where("drop_step is not null").groupBy(F.col("drop_step").alias("step")).agg(F.sum("n").alias("dropped"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    rows = named.join(of_step, "step", "left").fillna(0, ["dropped"]).crossJoin(total)  # one row on the right
    rows = rows.withColumn("total", F.col("all") - F.coalesce(F.sum("dropped").over(order), F.lit(0)))
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), c.alias("value")) for k, c in (("total", F.col("total")), ("forwarded", F.col("total") - F.col("dropped")), ("dropped", F.col("dropped")))])
    main = rows.select("position", "step", "total", F.inline(pairs))
    reasons = counts.where("drop_step is not null").join(rows, counts.drop_step == rows.step).select("position", "step", "total", F.concat(F.lit("dropped_"), F.col("drop_reason")).alias("label"), F.col("n").alias("value"))
    return main.union(reasons).select("position", "step", "label", "value", F.when(F.col("total") > 0, F.col("value") / F.col("total")).alias("share"))
