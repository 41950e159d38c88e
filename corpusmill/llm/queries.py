"""The thin opN_<name> queries over the driver's tables, and the SQL they are checked against.

Each query applies one operator, with production parameters, to its whole table and derives the contract's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, licenses, linededup, neardup, packing, pii, quality, tokenfiles
from .common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "quality."
    columns = [q + k for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = langid.train(docs.where("not held_out and doc_id is not null"), F.col("text"), F.col("lang"), F.col("doc_id"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path()
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return tokenfiles.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat.conversations(table(spark, sf_dir, "conversations"))
    told = lambda name: F.array_join(F.transform(name, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",").alias(name)
    return chat.preference_pairs(chat.contrast_pairs(convs)).select("conv_id", "usable", "prefix_turns", "prompt", "chosen_text", "rejected_text", told("chosen_mask"), told("rejected_mask"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), m["percent"].cast("string")))
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_matches", "licenses", F.array_join(told, ",").alias("matches"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.oracle_sql(), "op5_chat_formatting": chat.oracle_sql(), "op8_line_dedup": linededup.oracle_sql(), "op9_minhash_neardup": neardup.oracle_sql()}
