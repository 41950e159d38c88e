"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Everything is a built-in expression over one row: no shuffle, no user function. A rule is (reason, measure, side, percent, of): it
rejects when 100 * measure is beyond percent * of; `of` may be "1". Comparisons are of integers, so they don't depend on rounding.
The first rule that rejects, in table order, gives the reason.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import let


class Rule(NamedTuple):
    reason: str
    measure: str
    side: str
    percent: int
    of: str = "1"


#: Frequent function words of the languages that the corpus may hold.
STOP_WORDS = sorted(set(
    "the be to of and that have with a in is it for on as was at by this are from or an not he his they you we but "
    "le la les de des du un une et en que qui dans pour par sur au aux avec est ce il elle ne pas plus son se "
    "der die das und den dem von zu mit im auf ein eine nicht ist des sich auch es an als für wie wird bei oder "
    "el los las y del con para como más pero su al lo una o es por si no".split()
))

BASE_RULES = (
    Rule("too_few_words", "n_words", "<", 5000),
    Rule("repeated_words", "n_repeat_words", ">", 50, "n_words"),
)
RULES = (
    Rule("too_many_words", "n_words", ">", 100_000_000),
    Rule("short_words", "word_chars", "<", 300, "n_words"),
    Rule("long_words", "word_chars", ">", 1200, "n_words"),
    Rule("symbols", "n_symbols", ">", 10, "n_words"),
    Rule("exclamations", "n_exclamations", ">", 30, "n_words"),
    Rule("few_stop_words", "n_stop_words", "<", 5, "n_words"),
    Rule("repeated_lines", "n_dup_lines", ">", 50, "n_lines"),
)

SPACE = r"[ \t-\r]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeat_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a `width`-word window found twice or more. Windows are 64-bit hashes of their words."""

    def covered(windows: Column) -> Column:
        def from_sorted(pairs: Column) -> Column:
            # After the sort, equal windows are neighbours.
            twice = F.transform(
                pairs,
                lambda p, i: F.when(
                    F.coalesce(F.get(pairs, i - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False)), p["at"]
                ),
            )
            starts = F.array_sort(F.filter(twice, lambda x: x.isNotNull()))
            return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, i: F.coalesce(F.least(F.get(s, i + 1) - x, F.lit(width)), F.lit(width))), F.lit(0), lambda a, x: a + x))

        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, from_sorted))

    def of_hashes(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - width)
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])), covered)

    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).cast("long")


def measures(text: Column) -> Column:
    """A struct of the counts that rules refer to. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    count = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")

    def of(words: Column) -> Column:
        plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[.,;:!?]+$", ""))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            count(r"#*$%&|<>").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            repeat_words(words).alias("n_repeat_words"),
            count("!").alias("n_exclamations"),
            F.size(F.filter(plain, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    return let(words_of(text), of)


def verdict(rules: tuple[Rule, ...], measure) -> Column:
    """The reason of the first rule that rejects, or null. measure: name -> Column."""
    out = None
    for r in rules:
        left, right = 100 * measure(r.measure), r.percent * (F.lit(1) if r.of == "1" else measure(r.of))
        hit = left < right if r.side == "<" else left > right
        out = F.when(hit, r.reason) if out is None else out.when(hit, r.reason)
    return out


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_stop_words")


def judged(text: Column, rules: tuple[Rule, ...] = RULES, base_rules: tuple[Rule, ...] = BASE_RULES) -> Column:
    """struct of measures, base_failed, reason and kept. One expression: measures are taken once wherever the optimizer moves it, into a filter too."""

    def of(m: Column) -> Column:
        at = {"n_lines": m["lines"]["n"], "n_dup_lines": m["lines"]["dup"]}
        measure = lambda k: at[k] if k in at else m[k]
        fields = [measure(k).alias(k) for k in NAMES]
        base, reason = verdict(base_rules, measure), verdict(rules, measure)
        return F.struct(*fields, base.isNotNull().alias("base_failed"), F.coalesce(base, reason).alias("reason"), F.coalesce(base, reason).isNull().alias("kept"))

    return let(measures(text.cast("string")), of)


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base_rules: tuple[Rule, ...] = BASE_RULES, text_col: str = "text", out: str = "quality") -> DataFrame:
    """The input with one struct column, `out`: the measures, base_failed, reason (null: kept) and kept.

    Words are runs of other than ASCII white space. A null, empty or blank text has no words and fails. One row out for each row
    in, repeated rows and null ids included; an existing column named `out` is replaced, others pass through.
    """
    return docs.withColumn(out, judged(F.col(text_col), rules, base_rules))


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base_rules: tuple[Rule, ...] = BASE_RULES, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the input's columns and no other."""
    return docs.where(judged(F.col(text_col), rules, base_rules)["kept"])


def _sql_rule(r: Rule) -> str:
    return f"100 * {r.measure} {r.side} {r.percent} * {r.of}"


def oracle_sql() -> str:
    """DuckDB SQL of op1's rows."""
    words, rules = r"string_split_regex(t, '[ \t\n\x0b\f\r]+')", " or ".join(map(_sql_rule, RULES))
    listed = ", ".join("'" + w + "'" for w in STOP_WORDS)
    return rf"""
    with t as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    w as (select r, doc_id, t, list_filter({words}, lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) as l from t),
    g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2)),
    s as (select r, i, count(*) over (partition by r, g) as c from g),
    p as (select r, count(distinct i + k) as n_repeat_words from (select r, i, unnest([0, 1, 2]) as k from s where c > 1) group by r),
    m as (
      select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, length(regexp_replace(t, '[^!]', '', 'g')) as n_exclamations,
        len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
        len(list_filter(w, lambda x: regexp_replace(lower(x), '[.,;:!?]+$', '') in ({listed}))) as n_stop_words
      from w left join p using (r))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({" or ".join(map(_sql_rule, BASE_RULES))}) as base_failed,
      not ({" or ".join(map(_sql_rule, BASE_RULES))}) and not ({rules}) as kept from m
    """
