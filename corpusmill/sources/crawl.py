"""Crawl indexes and pools: language selection from a URL index, byte ranges of records, line-aligned pool batches, robots archives."""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterable
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T
from .http import get_range, open_any
from .warc import records, split_http

INDEX_COLUMNS = ("url", "url_host_name", "warc_filename", "warc_record_offset", "warc_record_length", "content_mime_detected", "content_languages")


def index_files(listing: bytes) -> list[str]:
    """Index files of the `warc` subset in a gzipped listing."""
    return [x for x in gzip.decompress(listing).decode().split() if "/subset=warc/" in x]


def crawl_of(path: str) -> str:
    return next((p.removeprefix("crawl=") for p in path.split("/") if p.startswith("crawl=")), "")


def select_language(index: DataFrame, language: str) -> DataFrame:
    """Index rows whose languages hold `language`, and whether it is the first. Unread columns aren't scanned; a missing language is no match."""
    languages = F.coalesce(F.col("content_languages"), F.lit(""))
    columns = [c for c in (*INDEX_COLUMNS, "crawl") if c in index.columns]
    return index.select(*columns).where(languages.contains(language)).withColumn("primary", languages.startswith(language))


def selection_summary(selected: DataFrame, crawl: str = "crawl") -> DataFrame:
    return selected.groupBy(crawl).agg(F.countDistinct("warc_filename").alias("files"), F.count("*").alias("matched"), F.count_if("primary").alias("primary"))


def compare_counts(ours: DataFrame, published: DataFrame) -> DataFrame:
    """(crawl, matched, published, difference): relative, null where nothing is published."""
    both = ours.select("crawl", "matched").join(published.select("crawl", F.col("count").alias("published")), "crawl", "left")
    return both.withColumn("difference", (F.col("matched") - F.col("published")) / F.nullif("published", F.lit(0)))


def coalesce(spans: Iterable[tuple[int, int]], max_gap: int = 1 << 14, max_bytes: int = 1 << 23) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, records) requests for (offset, length) records: one joins the request before it across gaps of at most max_gap, while the request has at most max_bytes."""
    out: list[tuple[int, int, list]] = []
    for at, size in sorted(spans):
        if out:
            start, end, held = out[-1]
            if at - end <= max_gap and at + size - start <= max_bytes:
                out[-1] = (start, max(end, at + size), [*held, (at, size)])
                continue
        out.append((at, at + size, [(at, size)]))
    return out


def plan_requests(selection: DataFrame, max_gap: int = 1 << 14, max_bytes: int = 1 << 23) -> DataFrame:
    """(warc_filename, start, end, records) of every file's requests. Records of a file are bounded by the archive, so a group is one task's work."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column("warc_filename").to_pylist()
        spans = coalesce(zip(table.column("warc_record_offset").to_pylist(), table.column("warc_record_length").to_pylist(), strict=True), max_gap, max_bytes)
        rows = [{"warc_filename": names[0], "start": a, "end": b, "records": [{"offset": o, "length": n} for o, n in held]} for a, b, held in spans]
        return pa.Table.from_pylist(rows, schema)

    record = pa.struct([("offset", pa.int64()), ("length", pa.int64())])
    schema = pa.schema([("warc_filename", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("records", pa.list_(record))])
    columns = selection.select("warc_filename", F.col("warc_record_offset").cast("long").alias("warc_record_offset"), F.col("warc_record_length").cast("long").alias("warc_record_length")).dropna()
    return columns.groupBy("warc_filename").applyInArrow(run, "warc_filename string, start long, end long, records array<struct<offset:long,length:long>>")


def gap_islands(records: DataFrame, group: str, offset: str, length: str, max_gap: int) -> DataFrame:
    """(group, start, end, records): the gap rule alone, as windows over each group's records in offset order."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(offset, length)
    reach = F.max(F.col(offset) + F.col(length)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = records.withColumn("__new", F.when(reach.isNull() | (F.col(offset) - reach > max_gap), 1).otherwise(0))
    numbered = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(group, "__island").agg(F.min(offset).alias("start"), F.max(F.col(offset) + F.col(length)).alias("end"), F.count("*").alias("records")).drop("__island")


def fetch_records(requests: DataFrame, base: str, per_second: float = 10.0, tasks: int = 16) -> DataFrame:
    """(warc_filename, offset, record, ok): each record as it lies in the archive; ok is false where its length or gzip mark is wrong, and the record null. The rate is shared among the tasks."""
    from .http import RateLimiter

    def run(batches):
        limiter = RateLimiter(per_second / tasks)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                place = base.rstrip("/") + "/" + r["warc_filename"]
                if place.startswith("http"):
                    data = get_range(place, r["start"], r["end"], limiter=limiter)
                else:
                    with open_any(place) as f:
                        f.seek(r["start"])
                        data = f.read(r["end"] - r["start"])
                for x in r["records"]:
                    part = data[x["offset"] - r["start"] :][: x["length"]]
                    ok = len(part) == x["length"] and part[:2] == b"\x1f\x8b"
                    rows.append((r["warc_filename"], x["offset"], part if ok else None, ok))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], ["warc_filename", "offset", "record", "ok"])

    return requests.repartition(tasks).mapInArrow(run, "warc_filename string, offset long, record binary, ok boolean")


class _Batch(InputPartition):
    def __init__(self, batch: str):
        self.batch = batch


class _PoolReader(DataSourceReader):
    def __init__(self, options: dict):
        self.batches, self.base, self.text, self.hint = json.loads(options["batches"]), options["base"].rstrip("/"), options.get("text", "true") == "true", options.get("hint", "")

    def partitions(self):
        return [_Batch(b) for b in self.batches]

    def read(self, partition):
        import zstandard

        def lines(name):
            raw = open_any(f"{self.base}/{partition.batch}/{name}")
            return io.TextIOWrapper(io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)), encoding="utf-8")

        meta = lines("metadata.zst")
        pairs = zip(meta, lines("text.zst"), strict=True) if self.text else zip(meta, repeat(None), strict=False)
        for number, (about, text) in enumerate(pairs):
            # A cheap test spares most lines the JSON parser.
            if self.hint in about:
                yield partition.batch, number, about, text


class PoolSource(DataSource):
    """Line-aligned zstd pairs of metadata and text, one task a batch: (batch, number, metadata, text), both JSON."""

    @classmethod
    def name(cls):
        return "poolbatch"

    def schema(self):
        return "batch string, number long, metadata string, text string"

    def reader(self, schema):
        return _PoolReader(dict(self.options))


def read_pool(spark: SparkSession, batches: list[str], base: str, language: str, min_probability: float = 0.5, identifier: str = "openlid-v3", text: bool = True) -> DataFrame:
    """(text, id, url, date, batch, language_score, allowed) of lines whose first guess is `language` with at least min_probability. `allowed` is false where robots.txt forbade the page: such rows are there to be counted. With text=False the
    text files aren't read and text is null."""
    spark.dataSource.register(PoolSource)
    rows = spark.read.format("poolbatch").option("batches", json.dumps(batches)).option("base", base).option("text", str(text).lower()).option("hint", language).load()
    about = F.from_json("metadata", f"u string, id string, ts string, allowed boolean, `{identifier}` struct<lang: array<string>, prob: array<double>>")
    rows = rows.withColumn("m", about).withColumn("g", F.col(f"m.`{identifier}`"))
    rows = rows.where((F.get("g.lang", F.lit(0)) == language) & (F.get("g.prob", F.lit(0)) >= min_probability))
    body = F.from_json("text", "text string")["text"]
    return rows.select(body.alias("text"), F.coalesce("m.id", F.concat_ws("/", "batch", F.col("number").cast("string"))).alias("id"), F.col("m.u").alias("url"), F.col("m.ts").alias("date"), "batch", F.get("g.prob", F.lit(0)).alias("language_score"), F.coalesce("m.allowed", F.lit(True)).alias("allowed"))


def robots_rows(path: str) -> list[tuple]:
    """(origin, status, body) of an archive of robots.txt responses, in order."""
    out = []
    with open_any(path) as raw:
        for headers, content in records(raw):
            url = headers.get("warc-target-uri", "")
            if headers.get("warc-type") == "response" and url.endswith("/robots.txt"):
                status, _, body = split_http(content)
                out.append((url.removesuffix("/robots.txt").lower(), status, body))
    return out


def read_robots(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The last (status, body) of each origin, in path order."""
    import pandas as pd

    from ..operators.policy import latest_robots

    def run(batches):
        for batch in batches:
            for number, path in zip(batch["number"], batch["path"], strict=True):
                rows = robots_rows(path)
                yield pd.DataFrame({"origin": [r[0] for r in rows], "status": [r[1] for r in rows], "body": [r[2] for r in rows], "at": [(int(number) << 32) + k for k in range(len(rows))]})

    listed = spark.createDataFrame(list(enumerate(sorted(paths))), "number int, path string").repartition(max(1, len(paths)), "number")
    return latest_robots(listed.mapInPandas(run, "origin string, status int, body binary, at long"), "at")


def load_list(spark: SparkSession, path: str, words: bool = False) -> DataFrame:
    """(entry) of a list file: comments and blank lines go; words are reduced to a-z and 0-9."""
    entry = T.strip(F.col("value"))
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select((F.regexp_replace(F.lower(entry), "[^a-z0-9]+", "") if words else entry).alias("entry"))
    return rows.where("entry <> ''").distinct()
