"""Scoring and training of document classifiers.

Models are injected: any object with a method that scores a list of texts. Where no such library is installed, the Spark ML models here take their place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import text as T
from .formatters import flatten
from .metrics import as_class


def score(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[float]]], key: str, text: str = "text", batch: int = 64, digits: int = 6) -> DataFrame:
    """docs with a score column; `load` runs once a worker and gives a function of a list of texts. Nothing is dropped."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load()
        for texts in batches:
            out: list[float] = []
            for k in range(0, len(texts), batch):
                out += list(scorer(texts.iloc[k : k + batch].fillna("").tolist()))
            yield pd.Series(out, dtype="float64").round(digits)

    return docs.withColumn(key, run(flatten(F.coalesce(F.col(text), F.lit("")))))


def with_class(docs: DataFrame, key: str) -> DataFrame:
    """Adds key_int, the score as a class from 0 to 5."""
    return docs.withColumn(f"{key}_int", as_class(F.col(key)))


def _features(bits: int) -> list:
    words = SQLTransformer(statement="SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[\\\\p{L}\\\\p{N}]+', 0) AS __w FROM __THIS__")
    pairs = NGram(n=2, inputCol="__w", outputCol="__w2")
    both = SQLTransformer(statement="SELECT *, concat(__w, __w2) AS __g FROM __THIS__")
    return [words, pairs, both, HashingTF(numFeatures=1 << bits, binary=True, inputCol="__g", outputCol="__f")]


def train_classifier(rows: DataFrame, label: str = "label", bits: int = 16, reg: float = 1e-3, steps: int = 30) -> PipelineModel:
    """Words and word pairs, hashed, into logistic regression; label is 0 or 1."""
    return Pipeline(stages=[*_features(bits), LogisticRegression(featuresCol="__f", labelCol=label, regParam=reg, maxIter=steps)]).fit(rows)


def train_regressor(rows: DataFrame, label: str = "score", bits: int = 14, reg: float = 0.1, steps: int = 30) -> PipelineModel:
    return Pipeline(stages=[*_features(bits), LinearRegression(featuresCol="__f", labelCol=label, regParam=reg, maxIter=steps, solver="l-bfgs")]).fit(rows)


def apply_model(docs: DataFrame, model: PipelineModel, key: str) -> DataFrame:
    """docs with the model's probability of 1, or its regression value, rounded to 6 or 4 places."""
    out = model.transform(docs)
    value = F.bround(vector_to_array("probability")[1], 6) if "probability" in out.columns else F.bround("prediction", 4)
    return out.withColumn(key, value).select(*docs.columns, key)


def balanced(positives: DataFrame, negatives: DataFrame, text: str = "text", seed: int = 0) -> DataFrame:
    """(text, label) rows, as many negatives as positives where there are more, in a hash order of their own."""
    order = lambda d: d.select(flatten(F.col(text)).alias("text")).withColumn("__h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("text")).cast("binary")))
    n = positives.count()
    rows = order(positives).withColumn("label", F.lit(1)).union(order(negatives).orderBy("__h", "text").limit(n).withColumn("label", F.lit(0)))
    return rows.orderBy("__h", "text", "label").drop("__h")


def conversation_text(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, text): turns in order, joined by spaces."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("at"), F.col(text).alias("text"))))
    return turns.groupBy(conv).agg(F.array_join(F.transform(ordered, lambda t: t["text"]), " ").alias("text"))


def conversations_column_text(conversations: Column) -> Column:
    """The same for a column of array<struct<from, value>>."""
    return F.array_join(F.transform(conversations, lambda t: t["value"]), " ")


def best_answers(rows: DataFrame, subreddit: str = "explainlikeimfive", min_score: int = 5, min_answers: int = 3) -> DataFrame:
    """(q_id, text): title, body and best answer (by score, then length) of questions with enough answers, the first row of each accepted question. rows: q_id, title, selftext, subreddit, answers<score, text>, and `at`, their order."""
    pairs = F.arrays_zip(F.col("answers.score").alias("score"), F.col("answers.text").alias("text"))
    best = F.array_max(F.transform(pairs, lambda p: F.struct(p["score"].alias("score"), F.length(p["text"]).alias("size"), p["text"].alias("text"))))
    rows = rows.where((F.col("subreddit") == subreddit) & (F.size("answers.text") >= min_answers)).withColumn("__best", best).where(F.col("__best.score") >= min_score)
    whole = T.strip(F.concat_ws("\n", "title", F.nullif("selftext", F.lit("")), "__best.text"))
    return rows.groupBy("q_id").agg(F.min_by(whole, "at").alias("text"))
