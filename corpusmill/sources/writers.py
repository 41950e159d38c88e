"""Document writers. Files are committed by Spark's own protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREVIEW = {"text": "string", "id": "string", "url": "string", "language": "string", "language_score": "double", "date": "string", "filter_reason": "string"}


def write_jsonl(docs: DataFrame, path: str, by: list[str] | None = None, compression: str = "gzip", mode: str = "error") -> None:
    """{"text", "id", "metadata": {...}} lines; null and empty fields are left out. `by` partitions folders by columns."""
    by = by or []
    rest = [c for c in docs.columns if c not in ("text", "id", *by)]
    clean = [F.nullif(F.col(c), F.lit("")).alias(c) if docs.schema[c].dataType.simpleString() == "string" else F.col(c) for c in rest]
    columns = [c for c in ("text", "id") if c in docs.columns] + by
    shaped = docs.select(*columns, *([F.struct(*clean).alias("metadata")] if rest else []))
    shaped.write.mode(mode).partitionBy(*by).option("ignoreNullFields", "true").json(path, compression=compression)


def write_parquet(docs: DataFrame, path: str, by: list[str] | None = None, compression: str = "zstd", schema: dict[str, str] | None = None, block_mb: int = 128, mode: str = "error") -> None:
    """Parquet with an explicit schema where one is given: columns it doesn't have are an error, those it lacks are null."""
    if schema is not None:
        if extra := set(docs.columns) - set(schema):
            raise ValueError(f"columns outside the schema: {sorted(extra)}")
        docs = docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])
    docs.write.mode(mode).partitionBy(*(by or [])).option("parquet.block.size", block_mb << 20).parquet(path, compression=compression)


def write_removed(verdicts: DataFrame, path: str, mode: str = "error") -> None:
    """Dropped documents in folders by step and reason."""
    from ..operators.verdict import removed

    removed(verdicts).write.mode(mode).partitionBy("step", "filter_reason").parquet(path, compression="zstd")


def preview_rows(docs: DataFrame) -> DataFrame:
    """The preview schema; all other columns are one JSON text, metadata."""
    rest = [c for c in docs.columns if c not in PREVIEW]
    fixed = [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in PREVIEW.items()]
    return docs.select(*fixed, F.to_json(F.struct(*rest)).alias("metadata") if rest else F.lit("{}").alias("metadata"))


def build_preview(kept: DataFrame, removed: dict[str, DataFrame], out: str, title: str, rows_per_file: int = 200_000) -> dict[str, int]:
    """A folder for each outcome (kept, removed_<step>) and a card; returns the counts."""
    spark, counts = kept.sparkSession, {}
    for name, docs in {"kept": kept, **{f"removed_{k}": v for k, v in removed.items()}}.items():
        preview_rows(docs).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{out}/{name}", compression="zstd")
        counts[name] = spark.read.parquet(f"{out}/{name}").count()
    spark.createDataFrame([(card(counts, title),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/card")
    return counts


def card(counts: dict[str, int], title: str) -> str:
    total = sum(counts.values()) or 1
    rows = [f"| {name} | {n:,} | {n / total:.1%} |" for name, n in counts.items()]
    heads = [f"- config_name: {name}\n  data_files: {name}/*.parquet" for name in counts]
    return "\n".join(["---", "configs:", *heads, "---", f"# {title}", "", "| outcome | documents | share |", "| --- | --- | --- |", *rows, ""])
