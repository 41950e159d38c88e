"""Line dedup by site-relative frequency: lines on more than a share of a host's pages are boilerplate and go.

Only hashes of lines are shuffled, and pre-aggregated where they are read; a host or line with a third of all rows is summed
in parts. Each page has finitely many lines, so the lines above a share r of a host's pages are at most (lines a page) / r: the
lists are short. They are broadcast only if they number at most `broadcast_rows`; beyond that the pages meet their host's list by a
join on host and salt, so that no host lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import Scratch, let

SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _worded(line: Column) -> Column:
    return line.rlike(r"[^ \t-\r]")


def boilerplate(pages: DataFrame, host: Column, text: Column, percent: int = 8, min_pages: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(host, line, pages, total): hashes of lines with a word that lie on at least min_pages pages and over percent % of their host's pages. A null host has no lines here."""
    rows = pages.select(host.alias("host"), text.alias("text")).where("host is not null")
    # A table, not an aggregate: where hosts are too many to broadcast, Spark can then split a host with most lines.
    totals = (scratch or Scratch(pages.sparkSession, "lines")).keep(rows.groupBy("host").agg(F.count("*").alias("total")))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _worded), lambda x: F.xxhash64(x)))
    counts = rows.where("text is not null").select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return counts.join(totals, "host").where(100 * F.col("pages") > percent * F.col("total")).select("host", "line", "pages", "total")


def drop_boilerplate(docs: DataFrame, percent: int = 8, min_pages: int = 5, host_col: str = "source", text_col: str = "text", broadcast_rows: int = 200_000, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """The input with text_col rewritten and two more columns (long), named by `counts` (None: not added): lines, and lines dropped. They replace columns of those names.

    A page counts once for a line however often it holds it. Lines are those between newlines; lines without a word stay.
    Each row is a page, repeated rows included. Null texts stay null with zero lines; rows with a null host are left as they are.
    A page all of whose lines go keeps an empty text; a very long page is one row like others. Other columns pass through.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    host, text = F.col(host_col).cast("string"), F.col(text_col).cast("string")
    found = scratch.keep(boilerplate(docs, host, text, percent, min_pages, scratch))
    # At most (lines a page) * 100 / percent hashes for a host.
    lists = found.groupBy("host").agg(F.collect_list("line").alias("__drop")).withColumnRenamed("host", "__host")
    rows = docs.withColumn("__h", host)
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = rows.join(F.broadcast(lists), F.col("__h") == F.col("__host"), "left")
    else:
        salts = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__s", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        joined = rows.join(salts, (F.col("__h") == F.col("__host")) & (F.col("__s") == F.col("__salt")), "left")
    drop = F.col("__drop")

    def rewrite(lines: Column) -> Column:
        # Which of its host's lines the page has is asked once, by hashing; each line is then looked up in those few.
        own = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), drop)
        kept = let(own, lambda o: F.filter(lines, lambda x: ~F.array_contains(o, F.xxhash64(x)) | ~_worded(x)))
        return let(kept, lambda k: F.struct(F.array_join(k, "\n").alias("text"), F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(k)).cast("long").alias("dropped")))

    whole = F.struct(text.alias("text"), F.size(_lines(text)).cast("long").alias("n"), F.lit(0).cast("long").alias("dropped"))
    out = joined.withColumn("__new", F.when(text.isNull(), F.lit(None)).when(drop.isNull(), whole).otherwise(let(_lines(text), rewrite)))
    new = {text_col: F.col("__new")["text"]}
    if counts:
        new |= {name: F.coalesce(F.col("__new")[k], F.lit(0)) for name, k in zip(counts, ("n", "dropped"), strict=True)}
    out = out.withColumns(new)
    return out.drop("__h", "__s", "__salt", "__host", "__drop", "__new")


def oracle_sql(percent: int = 8, min_pages: int = 5) -> str:
    """DuckDB SQL of op8's rows."""
    worded = r"regexp_matches(l, '[^ \t\n\x0b\f\r]')"
    return rf"""
    with t as (select row_number() over () as r, doc_id, source, text from documents),
    l as (select r, doc_id, source, l, i from (select r, doc_id, source, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from t where text is not null)),
    n as (select source, count(*) as total from t where source is not null group by source),
    b as (select source, l from (select source, l, count(distinct r) as pages from l where {worded} group by source, l) join n using (source)
      where pages >= {min_pages} and 100 * pages > {percent} * total),
    k as (select r, count(*) as n_lines, count(b.l) as n_dropped, coalesce(string_agg(l.l, chr(10) order by i) filter (where b.l is null), '') as text
      from l left join b on l.source = b.source and l.l = b.l group by r)
    select doc_id, k.text as text, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped from t left join k using (r)
    """
