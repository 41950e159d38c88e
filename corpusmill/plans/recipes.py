"""End-to-end recipes: functions of frames that give frames, and their staged runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..operators import dedup, filters, formatters
from ..operators.extract import extract
from ..operators.verdict import Step, apply_steps, kept
from ..sources import crawl, warc
from .manifest import Run


def quality_steps(text: str = "text") -> list[Step]:
    """Repetition, quality, C4 lines (terminal marks not asked for) and line ratios, in the order of the English recipe."""
    t = F.col(text)
    return [
        *filters.repetition_steps(),
        Step("gopher quality", lambda _: filters.gopher_quality(t)),
        Step("c4 quality", lambda _: filters.c4_verdict(t, terminal=False)["reason"], lambda x: filters.c4_verdict(x, terminal=False)["text"]),
        Step("fineweb quality", lambda _: filters.fineweb_quality(t)),
    ]


def english_pages(pages: DataFrame, blocked_domains: tuple[str, ...] = (), languages: tuple[str, ...] = ("en",), scores: Callable[[Column], Column] | None = None, threshold: float = 0.65, timeout: float = 1.0) -> DataFrame:
    """Verdicts over pages (url, html, cld2_languages?): URL rules and crawl tags before the costly extraction, then language and quality rules."""
    tags = F.col("cld2_languages") if "cld2_languages" in pages.columns else F.lit(None).cast("array<string>")
    early = [Step("url", lambda _: filters.url_filter(F.col("url"), domains=blocked_domains)), Step("crawl language", lambda _: filters.crawl_language(tags, languages))]
    out = apply_steps(pages.withColumn("text", F.lit(None).cast("string")), early)
    alive = F.col("drop_step").isNull()
    out = out.withColumn("__x", extract(F.when(alive, F.col("html")), timeout=timeout))
    out = out.withColumn("text", F.col("__x.text")).withColumn("__fail", F.when(alive & (F.col("__x.status") != "forwarded"), F.col("__x.status")))
    out = out.withColumn("drop_step", F.when(F.col("__fail").isNotNull(), "extraction").otherwise(F.col("drop_step"))).withColumn("drop_reason", F.coalesce("drop_reason", "__fail"))
    out, steps = out.drop("__x", "__fail"), quality_steps()
    if scores is not None:
        reason, name, score = filters.language(scores(F.col("text")), languages, threshold)
        out = out.withColumn("language", name).withColumn("language_score", score)
        steps = [Step("language", lambda _: reason), *steps]
    return apply_steps(out, steps)


ENGLISH_STEPS = ["url", "crawl language", "extraction", "language", "gopher repetition", "gopher quality", "c4 quality", "fineweb quality"]


def english_web(spark: SparkSession, paths: list[str], out: str, **options) -> DataFrame:
    """WARC archives to clean deduplicated documents, in resumable stages under `out`."""
    run = Run(spark, out)
    verdicts = run.stage("filtered", lambda: english_pages(warc.read_warc(spark, paths, cld2=True).where("not truncated"), **options))
    first = run.stage("deduplicated", lambda: dedup.minhash_dedup(kept(verdicts).drop("html"), order="id")[0])
    return run.stage("output", lambda: first.withColumn("text", formatters.mask_pii(F.col("text"))))


def language_selection(index: DataFrame, language: str, published: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, summary by crawl, with published counts where given)."""
    chosen = crawl.select_language(index, language)
    summary = crawl.selection_summary(chosen)
    return chosen, crawl.compare_counts(summary, published) if published is not None else summary


def fetch_selection(spark: SparkSession, selection: DataFrame, base: str, out: str, **options) -> DataFrame:
    """Fetched records of a selection, one stage a run; finished stages are read back."""
    run = Run(spark, out)
    requests = run.stage("requests", lambda: crawl.plan_requests(selection))
    return run.stage("records", lambda: crawl.fetch_records(requests, base, **options))


def pool_language(spark: SparkSession, batches: list[str], base: str, out: str, language: str, **options) -> DataFrame:
    """A language of a pool, the list of batches frozen by the first run."""
    run = Run(spark, out)
    frozen = run.stage("batches", lambda: spark.createDataFrame([(b,) for b in batches], "batch string"))
    names = sorted(r["batch"] for r in frozen.collect())  # a list of file names
    return run.stage("documents", lambda: crawl.read_pool(spark, names, base, language, **options).where("allowed"))
