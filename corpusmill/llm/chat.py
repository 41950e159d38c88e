"""Preference formatting: the longest common turn prefix of two conversations becomes the prompt, the rest paired masked completions.

All of it is built-in expressions over one row per pair. A turn is rendered as `<|role|>`, a newline, its text, `<|end|>` and
a newline. A mask is a list of [start, end) code-point spans in the completion: the text and end mark of each assistant turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import let, quoted, running

END = "<|end|>"
TURNS = "array<struct<role string, text string>>"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, turns): each conversation's turns in order of turn_col (ties by role, then text; exact repeats of a row count once). Rows with a null id go; a null role or text is read as empty.

    A conversation is one row of the result, so its turns meet in one task, however many they are; that is the only size that must fit an executor."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col)).agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    return rows.select(id_col, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading turns that are equal in both."""
    differ = F.zip_with(a, b, lambda x, y: ~((x["role"] == y["role"]) & (x["text"] == y["text"])))
    # Where one side has ended, the comparison is null: it differs there.
    first = F.array_position(F.transform(differ, lambda d: F.coalesce(d, F.lit(True))), True)
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(f"{END}\n"))), "")


def mask(turns: Column) -> Column:
    """[start, end) spans of assistant turns' text and end mark, as an array of structs."""
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + len(f"<||>\n{END}\n")
    of = lambda e, t, i: F.struct((F.get(e, i) - F.length(t["text"]) - len(f"{END}\n")).alias("start"), (F.get(e, i) - 1).alias("end"), t["role"].alias("role"))
    spans = let(running(F.transform(turns, size)), lambda e: F.transform(turns, lambda t, i: of(e, t, i)))
    return F.transform(F.filter(spans, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def preference_pairs(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """The input with prefix_turns, prompt, chosen_text, rejected_text, chosen_mask and rejected_mask.

    chosen_col and rejected_col hold arrays of (role, text) structs; a null array is an empty conversation, a null role or text
    is empty. The prompt never takes both sides whole: if one conversation begins with the other, its completion is what follows and
    the other's is empty; equal conversations have two empty completions. One row out for each row in, repeated rows included; very long conversations are rendered
    whole, in time that grows with their length. Columns that have the results' names are replaced (__a and __b are used and dropped), others pass through.
    """

    def clean(name: str) -> Column:
        turns = F.coalesce(F.col(name), F.array().cast(TURNS))
        return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    rows = pairs.withColumn("__a", clean(chosen_col)).withColumn("__b", clean(rejected_col))
    a, b = F.col("__a"), F.col("__b")
    rows = rows.withColumn("prefix_turns", common_prefix(a, b))
    n = F.col("prefix_turns")
    rest = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    rows = rows.withColumn("prompt", render(F.slice(a, 1, n))).withColumn("__a", rest(a)).withColumn("__b", rest(b))
    return rows.withColumns({"chosen_text": render(a), "rejected_text": render(b), "chosen_mask": mask(a), "rejected_mask": mask(b)}).drop("__a", "__b")


DONORS, BUCKET = 3, 1000


def contrast_pairs(convs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """For corpora without preference labels: (id_col, chosen, rejected, usable). rejected is the conversation with its last assistant turn replaced by another conversation's.

    Conversations are dealt by a hash of their id into buckets of about BUCKET, in each of which they are in order of that hash. The answer comes from the first of the DONORS next
    ones, then of the bucket's first ones, that gives another answer than its own. usable says whether there is one; where there is none, or no assistant turn, rejected equals chosen.
    """
    turns, spot, told = F.col("turns"), F.md5(F.col(id_col).cast("string").cast("binary")), F.col("__answer")
    buckets = max(1, convs.count() // BUCKET)
    at = F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    rows = convs.withColumns({"__last": F.array_max(at), "__spot": spot, "__bucket": F.conv(F.substring(spot, 1, 8), 16, 10).cast("long") % buckets})
    rows = rows.withColumn("__answer", F.get(turns, F.col("__last"))["text"])
    order = Window.partitionBy("__bucket", F.col("__last").isNull()).orderBy("__spot", id_col)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    donors = {f"__d{k}": F.lead(told, k + 1).over(order) for k in range(DONORS)} | {f"__d{k + DONORS}": F.nth_value(told, k + 1).over(whole) for k in range(DONORS)}
    rows = rows.withColumns(donors).withColumn("__other", F.coalesce(*[F.when(F.col(d) != told, F.col(d)) for d in donors]))
    swapped = F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("__last"), F.col("__other")).otherwise(t["text"]).alias("text")))
    usable = F.col("__other").isNotNull()
    return rows.select(*quoted([id_col]), turns.alias("chosen"), F.when(usable, swapped).otherwise(turns).alias("rejected"), usable.alias("usable"))


def oracle_sql() -> str:
    """DuckDB SQL of op5's rows."""
    show = lambda w: f"coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '{END}' || chr(10), '' order by i) filter ({w}), '')"
    spans = lambda w: f"coalesce(string_agg(case when role = 'assistant' then (e - length(text) - {len(END) + 1}) || ':' || (e - 1) end, ',' order by i) filter ({w}), '')"
    next_ones = [f"lead(answer, {k + 1}) over o as d{k}" for k in range(DONORS)] + [f"nth_value(answer, {k + 1}) over p as d{k + DONORS}" for k in range(DONORS)]
    return f"""
    with d as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
    t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) as i from d),
    k as (select conv_id, max(i) filter (role = 'assistant') as l, count(*) as size from t group by conv_id),
    a as (select conv_id, text as answer, md5(conv_id::varchar) as h from t join k using (conv_id) where i = l),
    b as (select *, ('0x' || substr(h, 1, 8))::ubigint % greatest(1, (select count(*) from k) // {BUCKET})::ubigint as bucket from a),
    w as (select conv_id, answer, {", ".join(next_ones)} from b
      window o as (partition by bucket order by h, conv_id), p as (partition by bucket order by h, conv_id rows between unbounded preceding and unbounded following)),
    r as (select conv_id, coalesce({", ".join(f"case when d{k} <> answer then d{k} end" for k in range(2 * DONORS))}) as other from w),
    c as (select conv_id, 0 as side, i, role, text from t union all
      select conv_id, 1, i, role, case when i = l and other is not null then other else text end from t join k using (conv_id) left join r using (conv_id)),
    p as (select conv_id, case when other is null then size else l - 1 end as p, other is not null as usable from k left join r using (conv_id)),
    s as (select conv_id, side, i, role, text, p, usable, sum(case when i > p then length(role) + length(text) + {len(f"<||>{END}") + 2} else 0 end) over (partition by conv_id, side order by i) as e
      from c join p using (conv_id))
    select conv_id, max(p)::int as prefix_turns, bool_or(usable) as usable, {show("side = 0 and i <= p")} as prompt, {show("side = 0 and i > p")} as chosen_text, {show("side = 1 and i > p")} as rejected_text,
      {spans("side = 0 and i > p")} as chosen_mask, {spans("side = 1 and i > p")} as rejected_mask from s group by conv_id
    """
