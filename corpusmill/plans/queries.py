"""The registered queries over the driver's tables, each beside the DuckDB SQL that checks it.

SQL texts are built from the same constants as the columns (word classes, thresholds), never from a plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decont, dedup, filters, formatters, metrics, split, tokenfolders
from ..operators import policy as P
from ..operators.durable import keep
from ..operators.extract import extract
from ..operators.verdict import Step, apply_steps
from ..sources import crawl
from ..sources.readers import adapt
from .report import funnel_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text():
    return F.col("text")


q = lambda pattern: "'" + pattern.replace("'", "''") + "'"
SP = T.SPACE
_words = lambda t: f"regexp_extract_all({t}, {q(T.WORDS)})"
_strip = lambda t: f"regexp_replace({t}, '^[{SP}]+|[{SP}]+$', '', 'g')"
_chars = lambda xs: f"length(array_to_string({xs}, ''))"
_lines_raw = rf"string_split_regex({{t}}, '\r\n|[\n\x0B\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"
_lines = lambda t: (lambda r: f"(case when {r}[-1] = '' then {r}[:-2] else {r} end)")(_lines_raw.replace("{t}", t).replace("{{", "{").replace("}}", "}"))
_simple = lambda t: _strip(rf"regexp_replace(regexp_replace(regexp_replace(lower({t}), '\p{{Nd}}+(?:[,.]\p{{Nd}}+)*', '0', 'g'), '\p{{P}}+', ' ', 'g'), '[{T.WHITE}]+', ' ', 'g')")
_grams = lambda w, n: f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


@query("select doc_id::varchar as id, text, lang, source, n_chars, 'web' as kind from documents where text is not null and text <> ''")
def read_adapt(spark, sf):
    return adapt(_table(spark, sf, "documents"), id="doc_id", defaults={"kind": "web"})


@query("select doc_id, n_chars from documents where n_chars > 500 and lang = 'en'")
def lambda_filter(spark, sf):
    return _table(spark, sf, "documents").where("n_chars > 500 and lang = 'en'").select("doc_id", "n_chars")


@query(f"select doc_id, len(w) as n_words, {_chars('w')} as word_chars from (select doc_id, {_words('text')} as w from documents)")
def split_words_stats(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.let(T.split_words(_text()), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), T.chars(w).alias("word_chars"))).alias("s")).select("doc_id", "s.*")


@query(f"select doc_id, {_simple('text')} as simple from documents")
def simplify_text(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.simplify_text(_text()).alias("simple"))


_marks = f"'[^{T.MARK_CLASS}]'"
_GOPHER = f"""
    with w as (select doc_id, text, {_words("text")} as w, case when len({_lines("text")}) = 0 then [text] else {_lines("text")} end as l from documents),
    c as (select *, list_filter(w, lambda x: regexp_matches(x, {_marks})) as c, len(w) as n from w),
    m as (select *, {_chars("c")} / nullif(len(c), 0) as mean,
      (length(text) - length(replace(text, '#', ''))) / nullif(n, 0) as hashes,
      ((length(text) - length(replace(text, '...', ''))) // 3 + length(text) - length(replace(text, '…', ''))) / nullif(n, 0) as dots,
      len(list_filter(l, lambda x: regexp_matches(x, '^[{SP}]*[•-]'))) / len(l) as bullets,
      len(list_filter(l, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…)[{SP}]*$'))) / len(l) as ends,
      len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) / nullif(n, 0) as alpha,
      len(list_intersect(list_distinct(w), {list(filters.ENGLISH_STOP_WORDS)})) as stops from c)
    select doc_id, case when n = 0 or len(c) < 50 then 'gopher_short_doc' when len(c) > 100000 then 'gopher_long_doc' when mean < 3 then 'gopher_below_avg_threshold'
      when mean > 10 then 'gopher_above_avg_threshold' when hashes > 0.1 then 'gopher_too_many_hashes' when dots > 0.1 then 'gopher_too_many_ellipsis'
      when bullets > 0.9 then 'gopher_too_many_bullets' when ends > 0.3 then 'gopher_too_many_end_ellipsis' when alpha < 0.8 then 'gopher_below_alpha_threshold'
      when stops < 2 then 'gopher_not_enough_stop_words' end as reason from m"""


@query(_GOPHER)
def gopher_quality(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", filters.gopher_quality(_text()).alias("reason"))


_worded = lambda xs: f"list_filter({xs}, lambda x: regexp_matches(x, '[^{SP}]'))"


@query(f"""
    with x as (select doc_id, text, string_split_regex({_strip("text")}, '\\n{{2,}}') as p, {_worded(_lines("text"))} as l from documents),
    m as (select doc_id, (len(p) - len(list_distinct(p))) / len(p) as pf, ({_chars("p")} - {_chars("list_distinct(p)")}) / length(text) as pc,
      (len(l) - len(list_distinct(l))) / nullif(len(l), 0) as lf, ({_chars("l")} - {_chars("list_distinct(l)")}) / length(text) as lc, len(l) as n from x)
    select doc_id, case when n = 0 then 'empty' when pf > 0.3 then 'dup_para_frac' when pc > 0.2 then 'dup_para_char_frac' when lf > 0.3 then 'dup_line_frac' when lc > 0.2 then 'dup_line_char_frac' end as reason from m""")
def gopher_repetition_lines(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", filters.repetition_lines(_text()).alias("reason"))


@query(f"""
    with w as (select doc_id, {_words("text")} as w from documents),
    g as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from w, (select unnest([2, 3, 4]) as n) where len(w) >= n)),
    c as (select doc_id, n, count(*) as c, min(i) as first, any_value(length(g) - n + 1) as size from g group by doc_id, n, g),
    t as (select doc_id, n, (arg_max(size, (c, -first)) + n - 1) * max(c) as chars from c group by doc_id, n)
    select doc_id, n::int as n, chars::bigint as chars from t""")
def gopher_repetition_top_ngram(spark, sf):
    """Characters of the commonest 2-, 3- and 4-gram of each document, counted where the document is read. Rows that repeat an id are one document, as in the SQL: their n-grams are grouped."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    # A table: Spark broadcasts it by its size, and where no id repeats the texts stay in place.
    twice = keep(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")))
    rows = lambda how: docs.join(twice, F.col("doc_id").eqNullSafe(F.col("again")), how).select("doc_id", T.split_words(_text()).alias("w"))
    alone = rows("left_anti").select("doc_id", F.posexplode(filters.top_ngrams(F.col("w"), (2, 3, 4))).alias("at", "chars")).where("chars is not null")
    return alone.select("doc_id", (F.col("at") + 2).alias("n"), "chars").union(_top_ngrams_grouped(rows("left_semi")))


def _top_ngrams_grouped(words: DataFrame) -> DataFrame:
    each = None
    for n in (2, 3, 4):
        rows = words.where(F.size("w") >= n).select("doc_id", F.lit(n).alias("n"), F.posexplode(T.ngrams(F.col("w"), n)).alias("at", "g"))
        each = rows if each is None else each.union(rows)
    counts = each.groupBy("doc_id", "n", "g").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    best = counts.groupBy("doc_id", "n").agg(F.max(F.struct("c", (-F.col("first")).alias("back"), (F.length("g") - F.col("n") + 1).alias("size"))).alias("b"))
    return best.select("doc_id", "n", ((F.col("b.size") + F.col("n") - 1) * F.col("b.c")).cast("long").alias("chars"))


@query()
def gopher_repetition_full(spark, sf):
    return apply_steps(_table(spark, sf, "documents"), filters.repetition_steps()).select("doc_id", F.col("drop_reason").alias("reason"))


@query(f"""
    with x as (select doc_id, text, {_worded("string_split(text, chr(10))")} as l, {_words("text")} as w from documents),
    m as (select doc_id, len(l) as n, len(list_filter(l, lambda x: regexp_matches(regexp_replace(x, '[{SP}]+$', ''), '[{T.terminal_class()}]$'))) / nullif(len(l), 0) as ended,
      len(list_filter(l, lambda x: length(x) <= 30)) / nullif(len(l), 0) as short, ({_chars("l")} - {_chars("list_distinct(l)")}) / nullif(length(replace(text, chr(10), '')), 0) as dup,
      (length(text) - length(replace(text, chr(10), ''))) / greatest(len(w), 1) as breaks from x)
    select doc_id, case when n = 0 then 'empty' when ended < 0.12 then 'line_punct_ratio' when short > 0.67 then 'short_line_ratio' when dup > 0.01 then 'char_dup_ratio' when breaks > 0.3 then 'list_ratio' end as reason from m""")
def fineweb_quality(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", filters.fineweb_quality(_text()).alias("reason"))


_policy_words = "|".join(filters.POLICY)
_C4 = f"""
    with r as (select doc_id, i, {_strip("l")} as raw from (select doc_id, unnest(l) as l, generate_subscripts(l, 1) as i from (select doc_id, {_lines("text")} as l from documents))),
    x as (select doc_id, i, raw, regexp_replace(raw, '\\[[0-9]*\\]|\\[edit\\]|\\[citation needed\\]', '', 'g') as line from r),
    a as (select doc_id, i, line, case when len(list_filter(regexp_extract_all(raw, '[^{SP}]+'), lambda w: length(w) > 1000)) > 0 then 'too_long_word'
      when {{terminal}} and (not regexp_matches(line, '[.?!"'']$') or line like '%...') then 'no_terminal_punct' when len(regexp_extract_all(raw, '[^{SP}]+')) < 3 then 'too_few_words'
      when contains(lower(line), 'lorem ipsum') then 'lorem_ipsum' when contains(lower(line), 'javascript') then 'javascript' when contains(line, '{{') then 'curly_bracket'
      when regexp_matches(lower(line), '{_policy_words}') then 'policy' else 'keep' end as action from x)"""


@query(_C4.replace("{terminal}", "true") + " select action, count(*) as lines from a group by action")
def c4_lines(spark, sf):
    lines = _table(spark, sf, "documents").select(F.explode(filters.c4_lines(_text())).alias("x"))
    return lines.groupBy("x.action").agg(F.count("*").alias("lines"))


@query(_C4.replace("{terminal}", "false") + f"""
    select d.doc_id, coalesce(arg_min(action, i) filter (action in ('lorem_ipsum', 'curly_bracket')),
      case when coalesce(sum(case when line = '' then 0 else len(regexp_extract_all(line, '[.!?…]+["''”’)\\]]*[{SP}]+[^{SP}]')) + 1 end) filter (action = 'keep'), 0) < 5 then 'too_few_sentences' end) as reason,
      {_strip("coalesce(string_agg(line, chr(10) order by i) filter (action = 'keep'), '')")} as text from documents d left join a using (doc_id) group by d.doc_id""")
def c4_quality(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", filters.c4_verdict(_text(), terminal=False).alias("v")).select("doc_id", "v.*")


@query(f"""
    with l as (select doc_id, unnest(l) as l, generate_subscripts(l, 1) as i from (select doc_id, string_split(text, chr(10)) as l from documents))
    select doc_id, coalesce(string_agg(l, chr(10) order by i) filter (not (regexp_matches(l, '^[{T.MARK_CLASS}{SP}]*$') and regexp_matches(l, '[^{SP}]'))), '') as text from l group by doc_id""")
def symbol_lines(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", formatters.symbol_lines(_text()).alias("text"))


@query("""
    with s as (select doc_id, lang, (doc_id % 100) / 100 as p from documents)
    select doc_id, case when p >= 0.5 then lang else 'zz' end as language, round_even(greatest(p, 1 - p), 4) as language_score,
      case when (case when p >= 0.5 then lang else 'zz' end) not in ('en', 'fr') then 'other_language' when greatest(p, 1 - p) < 0.65 then 'low_confidence' end as reason from s""")
def language_filter(spark, sf):
    """Scores are made up from doc_id: p for the document's language, 1 - p for zz."""
    p = (F.col("doc_id") % 100) / 100
    reason, name, score = filters.language(F.create_map("lang", p, F.lit("zz"), 1 - p), ["en", "fr"])
    return _table(spark, sf, "documents").select("doc_id", name.alias("language"), score.alias("language_score"), reason.alias("reason"))


_BLOCKED, _BANNED, _SOFT, _SUB = ["example.org"], ["erth"], ["page", "ref", "utm"], ["thth"]


@query(f"""
    with p as (select page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host, list_distinct(string_split_regex(lower(url), '[^a-z0-9]+')) as w, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') as c from pages)
    select page_id, case when url is null or url = '' then 'missing_url' when regexp_extract(host, '([^.]+\\.[^.]+)$', 1) in ({", ".join(map(q, _BLOCKED))}) then 'domain'
      when len(list_intersect(w, {_BANNED})) > 0 then 'banned_word' when len(list_intersect(w, {_SOFT})) >= 2 then 'soft_banned_words' when contains(c, '{_SUB[0]}') then 'banned_subword' end as reason from p""")
def url_filter(spark, sf):
    return _table(spark, sf, "pages").select("page_id", filters.url_filter(F.col("url"), domains=_BLOCKED, banned=_BANNED, soft=_SOFT, subwords=_SUB).alias("reason"))


@query("""
    select page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') as host, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) as origin,
      regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '([^.]+\\.[^.]+)$', 1) as domain from pages""")
def url_parts(spark, sf):
    url = F.col("url")
    return _table(spark, sf, "pages").select("page_id", T.host_of(url).alias("host"), T.origin_of(url).alias("origin"), filters.registrable(F.lower(F.try_parse_url(url, F.lit("HOST"))), ["com", "net", "org"]).alias("domain"))


_REGISTRY = ["example.net  # all of it", "https://www.blog.example.com/en/", "# nothing"]


@query(r"""
    select page_id, regexp_matches(h, '(^|\.)example\.net$') or starts_with(regexp_replace(regexp_replace(lower(url), '^.*?://', ''), '^www\.', ''), 'blog.example.com/en/') as opted_out
    from (select page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') as h from pages)""")
def policy_registry(spark, sf):
    return _table(spark, sf, "pages").select("page_id", P.in_registry(F.col("url"), _REGISTRY).alias("opted_out"))


@query(r"""
    select page_id, case when page_id % 7 = 0 then 'x_robots_noai' when regexp_matches(lower(html), '<meta\s[^>]*name=[''"](robots|googlebot)[''"][^>]*\bnoai\b') then 'meta_noai' end as policy_reason, true as robots_unknown from pages""")
def page_opt_out(spark, sf):
    """Signals of headers and meta tags; every seventh page gets a header that opts out."""
    head = F.when(F.col("page_id") % 7 == 0, F.create_map(F.lit("X-Robots-Tag"), F.lit("noai"))).otherwise(F.create_map(F.lit("Server"), F.lit("x")))
    none = spark.createDataFrame([], "origin string, status int, body string")
    return P.policy(_table(spark, sf, "pages").withColumn("headers", head), none, headers="headers").select("page_id", "policy_reason", "robots_unknown")


@query(r"""
    with p as (select page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) as origin, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path from pages)
    select page_id, case when origin like '%.example.com' and starts_with(path, '/en/') then 'robots_disallow' when origin like '%.example.net' and not starts_with(path, '/fr/') then 'ai_agent_blocked' end as policy_reason,
      not (origin like '%.example.com' or origin like '%.example.net') as robots_unknown from p""")
def robots_gate(spark, sf):
    """robots.txt made up for two of the three domains."""
    pages = _table(spark, sf, "pages")
    origins = pages.select(T.origin_of(F.col("url")).alias("origin")).distinct()
    bodies = F.when(F.col("origin").endswith(".example.com"), "User-agent: *\nDisallow: /en/\n").when(F.col("origin").endswith(".example.net"), "User-agent: GPTBot\nDisallow: /\nAllow: /fr/\n")
    return P.policy(pages, origins.select("origin", F.lit(200).alias("status"), bodies.alias("body")).where("body is not null")).select("page_id", "policy_reason", "robots_unknown")


@query()
def extract_text(spark, sf):
    return _table(spark, sf, "pages").select("page_id", extract(F.col("html"), timeout=5.0).alias("x")).select("page_id", "x.text", "x.status")


@query()
def pii_mask(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", formatters.mask_pii(_text()).alias("text"))


@query(f"select doc_id, regexp_replace(text, {q(formatters.EMAIL)}, 'email@example.com', 'g') as text from documents")
def email_mask(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.regexp_replace(_text(), formatters.EMAIL, "email@example.com").alias("text"))


@query("select doc_id from documents qualify row_number() over (partition by text order by doc_id) = 1")
def exact_dedup(spark, sf):
    return dedup.exact_dedup(_table(spark, sf, "documents"))[0].select("doc_id")


@query("select doc_id from documents qualify row_number() over (partition by text order by doc_id) > 1")
def exact_dedup_removed(spark, sf):
    return dedup.exact_dedup(_table(spark, sf, "documents"))[1].select("doc_id")


_WIDTH, _BANDS, _ROWS = 5, 14, 8
_A, _B = ([int(x) for x in xs] for xs in dedup.constants(_BANDS * _ROWS, 1))
_low = lambda x: f"(({x}) & 18446744073709551615::uhugeint)"
_shingle = " + ".join(_low(f"h[i + {k}]::uhugeint * {p}::uhugeint") for k, p in enumerate(dedup.powers(_WIDTH)))
_MINHASH = f"""
    with recursive w as (select doc_id, list_transform(string_split({_simple("text")}, ' '), lambda x: ('0x' || substr(md5(x), 1, 16))::ubigint) as h from documents),
    s as (select distinct doc_id, {_low(_shingle)} as s from (select doc_id, h, unnest(range(1, len(h) - {_WIDTH - 2})) as i from w where len(h) >= {_WIDTH})),
    f as (select unnest(range(0, {len(_A)})) as j, unnest({_A}) as a, unnest({_B}) as b),
    x as (select doc_id, j, {_low("s * a::uhugeint + b::uhugeint")}::ubigint as x from s, f),
    m as (select doc_id, j, min(x % {dedup.PRIME}) as v from x group by doc_id, j),
    k as (select doc_id, j // {_ROWS} as band, string_agg(v::varchar, ',' order by j) as key from m group by doc_id, band),
    e as (select distinct doc_id as x, least as y from (select doc_id, min(doc_id) over (partition by band, key) as least from k) where doc_id <> least)"""


@query(_MINHASH + " select doc_id, string_agg(v::varchar, ',' order by j) as signature from documents left join m using (doc_id) group by doc_id")
def minhash_signature(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", dedup.signature(_text()).alias("signature")).select("doc_id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query(_MINHASH + " select x, y from e")
def minhash_pairs(spark, sf):
    signed = keep(_table(spark, sf, "documents").select("doc_id", dedup.signature(_text()).alias("signature")))
    return dedup.star_edges(signed, "doc_id", "signature")


@query(_MINHASH + """, b as (select x, y from e union all select y, x from e), g as (select x, y from b union select g.x, b.y from g join b on g.y = b.x)
    select doc_id from documents where doc_id not in (select x from g where y < x)""")
def minhash_dedup(spark, sf):
    return dedup.minhash_dedup(_table(spark, sf, "documents"))[0].select("doc_id")


_N = 13
_DECONT = f"""
    with i as (select distinct item_id, g from (select item_id, unnest({_grams("w", _N)}) as g from (select item_id, string_split({_simple("text")}, ' ') as w from benchmark))),
    d as (select distinct doc_id, g from (select doc_id, unnest({_grams("w", _N)}) as g from (select doc_id, string_split({_simple("text")}, ' ') as w from documents)) where g in (select g from i)
      and 2 * len(list_filter(string_split(g, ' '), lambda x: length(x) > 1)) >= {_N}),
    c as (select g, count(*) as documents from d group by g), s as (select g from i group by g having count(*) > {{items}})"""


@query(_DECONT.replace("{items}", "10") + " select g as gram, documents from c")
def decont_counts(spark, sf):
    return decont.gram_counts(_table(spark, sf, "documents"), decont.ngram_index(_table(spark, sf, "benchmark"), _N), _N)


def _leaky(docs: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    index = decont.ngram_index(items, _N)
    found = keep(decont.matches(docs, index, _N))
    return decont.contaminated(docs, index, decont.gram_counts(docs, index, _N, found=found), _N, max_documents=limit, found=found)


def _decont_filter(limit: int) -> str:
    return _DECONT.replace("{items}", "10") + f" select distinct doc_id from d where g not in (select g from s) and g not in (select g from c where documents > {limit})"


@query(_decont_filter(10))
def decont_filter(spark, sf):
    return _leaky(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), 10)


@query(_decont_filter(1))
def decont_filter_rare(spark, sf):
    """n-grams of more than one document count as boilerplate."""
    return _leaky(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), 1)


@query(_DECONT.replace("{items}", "10") + " select distinct item_id from i where g in (select g from c where documents <= 10) and g not in (select g from s)")
def decont_items(spark, sf):
    docs, index = _table(spark, sf, "documents"), decont.ngram_index(_table(spark, sf, "benchmark"), _N)
    return decont.items_with(index, decont.contaminating(index, decont.gram_counts(docs, index, _N)))


@query(_DECONT.replace("{items}", "10") + f""",
    w as (select doc_id, string_split({_simple("text")}, ' ') as w from documents),
    p as (select distinct doc_id, i + k as at from (select doc_id, i, unnest(range(0, {_N})) as k from (select doc_id, w, unnest(range(1, len(w) - {_N - 2})) as i from w) where array_to_string(w[i:i + {_N - 1}], ' ') in (select g from i)))
    select doc_id, count(*) / any_value(len(w)) as covered from p join w using (doc_id) group by doc_id""")
def covered_fraction(spark, sf):
    return decont.covered_fraction(_table(spark, sf, "documents"), decont.ngram_index(_table(spark, sf, "benchmark"), _N), _N)


@query(f"select doc_id from documents where ('0x' || substr(md5('holdout|' || text), 1, 16))::ubigint < {int(0.05 * 2**64)}")
def holdout_split(spark, sf):
    return split.holdout_split(_table(spark, sf, "documents"), 0.05, native=True)[1].select("doc_id")


@query()
def holdout_split_blake(spark, sf):
    return split.holdout_split(_table(spark, sf, "documents"), 0.05)[1].select("doc_id")


@query(f"select doc_id, array_to_string({_lines(_strip('text'))}, ' ') as line from documents")
def flatten_text(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", formatters.flatten(_text()).alias("line"))


@query(r"""
    select page_id, case when regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '(^|\.)example\.org$') then 'domain' when url = (select url from pages order by page_id limit 1) then 'url' end as list_reason from pages""")
def url_lists(spark, sf):
    """Domain and URL lists as tables of any size."""
    pages = _table(spark, sf, "pages")
    first = pages.orderBy("page_id").limit(1).select(F.lit("url").alias("kind"), F.regexp_replace("url", r"^.*?://", "").alias("entry"))
    lists = spark.createDataFrame([("domain", "example.org")], "kind string, entry string").union(first)
    return filters.url_lists_filter(pages, lists).select("page_id", "list_reason")


@query()
def telugu_quality(spark, sf):
    return apply_steps(_table(spark, sf, "documents"), filters.telugu_steps()).select("doc_id", "drop_step", "drop_reason")


@query()
def fix_encoding(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", formatters.fix_encoding(_text()).alias("text"))


@query()
def quality_classifier(spark, sf):
    """A classifier of the quality labels, scoring every document."""
    from ..operators.classify import apply_model, train_classifier

    docs = _table(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return apply_model(docs, train_classifier(labelled), "score").select("doc_id", "score")


_FUNNEL = ["length", "gopher quality", "repeated lines"]


def _funnel_verdicts(spark, sf):
    steps = [
        Step("length", lambda _: F.when(F.length("text") < 400, "short")),
        Step("gopher quality", lambda _: filters.gopher_quality(_text())),
        Step("repeated lines", lambda _: filters.repetition_lines(_text())),
    ]
    return apply_steps(_table(spark, sf, "documents"), steps)


@query(f"""
    with g as ({_GOPHER}), r as ({SQL["gopher_repetition_lines"]}),
    v as (select case when length(text) < 400 then 0 when g.reason is not null then 1 when r.reason is not null then 2 end as s, case when length(text) < 400 then 'short' else coalesce(g.reason, r.reason) end as reason
      from documents join g using (doc_id) join r using (doc_id)),
    n as (select i, name, count(*) filter (s is null or s >= i) as total, count(*) filter (s = i) as dropped from v, (select unnest([0, 1, 2]) as i, unnest({_FUNNEL}) as name) group by i, name),
    u as (select name, 'total' as key, total as value, total from n union all select name, 'forwarded', total - dropped, total from n union all select name, 'dropped', dropped, total from n
      union all select name, 'dropped_' || reason, count(*), any_value(total) from v join n on s = i group by name, reason)
    select 'funnel' as section, name as group, key, value, value / total as share from u""")
def funnel_report(spark, sf):
    return funnel_rows(_funnel_verdicts(spark, sf), _FUNNEL)


@query("select source as key, count(*) as value, count(*) / (select count(*) from documents) as share from documents group by source order by value desc, key limit 20")
def top_sources(spark, sf):
    return metrics.top_counts(_table(spark, sf, "documents"), F.col("source"))


@query("select sum(length(text))::bigint as total, count(*) as n, round(avg(length(text)), 6) as mean, min(length(text)) as min, max(length(text)) as max, round(var_samp(length(text)), 2) as variance from documents")
def doc_len_stats(spark, sf):
    rows = _table(spark, sf, "documents").select(F.length("text").cast("long").alias("size")).agg(*metrics.metric(F.col("size")))
    return rows.withColumn("mean", F.round("mean", 6)).withColumn("variance", F.round("variance", 2))


@query("select doc_id from (select doc_id, md5('7|' || doc_id::varchar) as h from documents where regexp_matches(text, 'Licen[sc]e')) order by h, doc_id limit 25")
def select_sample(spark, sf):
    return split.sample(split.select(_table(spark, sf, "documents"), grep="Licen[sc]e"), 25, 7).select("doc_id")


@query("""
    with r as (select doc_id, round_even(least(5, n_chars / 1000.0), 0)::int as p, (quality * 3 + toxic)::int as a from labels join documents using (doc_id)),
    k as (select unnest(range(0, 6)) as c), f as (select c, 2 * count(*) filter (p = c and a = c) / nullif(count(*) filter (p = c) + count(*) filter (a = c), 0) as f1 from r, k group by c)
    select round((select avg(f1) from f), 9) as macro_f1, round(2 * count(*) filter (p >= 3 and a >= 3) / (count(*) filter (p >= 3) + count(*) filter (a >= 3)), 9) as binary_f1, round(count(*) filter (p = a) / count(*), 9) as exact from r""")
def label_metrics(spark, sf):
    rows = _table(spark, sf, "labels").join(_table(spark, sf, "documents"), "doc_id")
    found = metrics.evaluate(rows, F.col("n_chars") / 1000, F.col("quality") * 3 + F.col("toxic"))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query("""
    with r as (select doc_id, n_chars::double as x, (quality * 2 - toxic)::double as y from labels join documents using (doc_id)),
    k as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 as ry,
      row_number() over (order by x desc, doc_id) as px, row_number() over (order by y desc, doc_id) as py, greatest(1, floor(count(*) over () * 0.1)) as k from r)
    select round(corr(rx, ry), 9) as spearman, round(corr(x, y), 9) as pearson, round(count(*) filter (px <= k and py <= k) / any_value(k), 9) as top_overlap, count(*) as n from k""")
def agreement(spark, sf):
    rows = _table(spark, sf, "labels").join(_table(spark, sf, "documents"), "doc_id")
    rows = rows.select("doc_id", F.col("n_chars").cast("double").alias("x"), (F.col("quality") * 2 - F.col("toxic")).cast("double").alias("y"))
    return metrics.agreement(rows, "x", "y", "doc_id").select(*[F.round(c, 9).alias(c) for c in ("spearman", "pearson", "top_overlap")], "n")


@query("""
    select doc_id, quality, row_number() over (partition by quality order by md5('42|' || doc_id::varchar), doc_id) <= round_even(count(*) over (partition by quality) * 0.1::double, 0) as is_test from labels""")
def stratified_split(spark, sf):
    return split.stratified_split(_table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("select conv_id, string_agg(text, ' ' order by turn) as text from conversations group by conv_id")
def conversation_text(spark, sf):
    from ..operators.classify import conversation_text as run

    return run(_table(spark, sf, "conversations"))


def _small_tokenizer(spark, sf) -> str:
    """A published vocabulary where there is one; nothing is trained."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def tokenize_lengths(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", tokenfolders.token_counts(_text(), _small_tokenizer(spark, sf)).alias("n_tokens"))


_GAP = 40
_RANGES = "select l_suppkey as file, l_orderkey * 100 as pos, (l_linenumber * 9)::bigint as size from lineitem"


@query(f"""
    with r as ({_RANGES}), m as (select *, max(pos + size) over (partition by file order by pos, size rows between unbounded preceding and 1 preceding) as reach from r),
    n as (select *, sum(case when reach is null or pos - reach > {_GAP * 1000} then 1 else 0 end) over (partition by file order by pos, size rows unbounded preceding) as island from m)
    select file, min(pos) as start, max(pos + size) as "end", count(*) as records from n group by file, island""")
def range_coalesce(spark, sf):
    rows = _table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 100).alias("at"), (F.col("l_linenumber") * 9).cast("long").alias("size"))
    return crawl.gap_islands(rows, "file", "at", "size", _GAP * 1000)


@query("""
    select crawl, count(distinct warc_filename) as files, count(*) as matched, count(*) filter (starts_with(content_languages, 'fr')) as primary
    from (select 'crawl-' || (doc_id % 3)::varchar as crawl, source as warc_filename, lang || ',en' as content_languages from documents) where contains(content_languages, 'fr') group by crawl""")
def language_selection(spark, sf):
    """An index made up from documents: the language column, then English."""
    rows = _table(spark, sf, "documents").select(F.concat(F.lit("crawl-"), (F.col("doc_id") % 3).cast("string")).alias("crawl"), F.col("source").alias("warc_filename"), F.concat("lang", F.lit(",en")).alias("content_languages"))
    return crawl.selection_summary(crawl.select_language(rows, "fr"))


@query(f"""
    with g as ({_GOPHER}), r as ({SQL["gopher_repetition_lines"]}),
    k as (select doc_id, text from documents join g using (doc_id) join r using (doc_id) where g.reason is null and r.reason is null),
    u as (select doc_id, text from k qualify row_number() over (partition by text order by doc_id) = 1),
    bad as ({_decont_filter(10)})
    select doc_id, text from u where doc_id not in (select doc_id from bad)""")
def flagship(spark, sf):
    """Quality and repetition rules, exact dedup, decontamination against the benchmark."""
    docs = _table(spark, sf, "documents")
    # Plain conditions: a filter on verdicts would be moved below them, with copies of the rules.
    good = docs.where(filters.gopher_quality(_text()).isNull()).where(filters.repetition_lines(_text()).isNull())
    # A table: exact_dedup reads its input twice, and the rules are dearer than a reading.
    unique = dedup.exact_dedup(keep(good.select("doc_id", "text")))[0]
    bad = _leaky(docs, _table(spark, sf, "benchmark"), 10)
    return unique.join(bad, "doc_id", "left_anti").select("doc_id", "text")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

