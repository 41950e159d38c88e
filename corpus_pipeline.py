"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of `documents`. Rows with a null doc_id pass every stage on their own merit: no near-duplicate link reaches them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontam, linededup, neardup, packing, quality
from corpusmill.llm.common import Scratch, quoted, table
from corpusmill.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many documents of their source go; n_chars follows the text."""
    new = linededup.drop_boilerplate(docs, counts=None)
    return new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else new


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays. Rows of one id are one document: its different texts stay or go together, in one row each;
    of rows that repeat id and text the one stays that is least by its other columns."""
    found = neardup.near_duplicates(docs, width=5, percent=80)
    gone = found.where("not kept").select("doc_id").distinct()
    # Ids alone are counted; where none repeats, what is joined below is empty, and Spark drops the join when it sees that.
    twice = Scratch(spark, "repeated").keep(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti").select(*quoted(docs.columns))
    rest = [name for name in docs.columns if name not in ("doc_id", "text")]
    firsts = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*quoted(rest))).alias("rest") if rest else F.lit(None).alias("rest"))
    once = firsts.select("doc_id", "text", *[F.col("rest")[name].alias(name) for name in rest]).select(*quoted(docs.columns))
    return kept.join(twice, "doc_id", "left_anti").select(*quoted(docs.columns)).union(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids, a row for each piece of a document."""
    return packing.pack(docs, tokenizer_path(), end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_neardup", minhash_neardup),
    ("decontamination", decontamination),
    ("packing", pack_sequences),
]

#: Near-duplicate components, edit distances in texts and byte-level BPE have no SQL: tests/llm/test_pipeline.py holds run() and each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
