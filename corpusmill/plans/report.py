"""Reports: the funnel, languages and domains of a run, as rows (section, group, key, value, share) and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import host_of
from ..operators.metrics import top_counts
from ..operators.verdict import funnel


def funnel_rows(verdicts: DataFrame, steps: list[str]) -> DataFrame:
    rows = funnel(verdicts, steps).orderBy("position", F.expr("case label when 'total' then 0 when 'forwarded' then 1 when 'dropped' then 2 else 3 end"), "label")
    return rows.select(F.lit("funnel").alias("section"), F.col("step").alias("group"), F.col("label").alias("key"), "value", "share")


def count_rows(kept: DataFrame, top: int = 20, language: str = "language", url: str = "url") -> DataFrame:
    total = kept.agg(F.lit("total").alias("key"), F.count("*").alias("value")).withColumn("share", F.when(F.col("value") > 0, 1.0))
    parts = [("documents", total)]
    parts += [("language", top_counts(kept, F.col(language), top))] if language in kept.columns else []
    parts += [("domain", top_counts(kept, host_of(F.col(url)), top))] if url in kept.columns else []
    out = None
    for section, rows in parts:
        rows = rows.select(F.lit(section).alias("section"), F.lit("kept").alias("group"), "key", "value", "share")
        out = rows if out is None else out.union(rows)
    return out


def build_report(verdicts: DataFrame, steps: list[str], top: int = 20) -> DataFrame:
    from ..operators.verdict import kept

    return funnel_rows(verdicts, steps).union(count_rows(kept(verdicts), top))


def save_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(path, compression="zstd")


def render_report(rows: list) -> str:
    wide = max((len(r["key"] or "") for r in rows), default=8)
    out, last = [], None
    for r in rows:
        title = r["group"] if r["section"] == "funnel" else f"{r['section']} of {r['group']}"
        if title != last:
            out += ([""] if out else []) + [title]
            last = title
        out.append(f"  {(r['key'] or ''):<{wide}}  {r['value']:>14,}" + (f"  {r['share']:>8.2%}" if r["share"] is not None else ""))
    return "\n".join(out)
