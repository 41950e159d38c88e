"""Document filters as reasons: a column that names the first failing rule, or is null.

Thresholds that are None are off; in the Gopher rules 0 is off as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import text as T
from .verdict import ALIVE_TEXT, Step, first_reason

ENGLISH_STOP_WORDS = ("and", "be", "have", "of", "that", "the", "to", "with")
TELUGU_STOP_WORDS = ("ఈ", "ఉంది", "ఉన్నాయి", "కి", "కేంద్రం", "గ్రామం", "దూరంలో", "నుండి", "మీ")
TOP_NGRAMS = {n: (24 - 2 * n) / 100 for n in range(2, 5)}
DUPLICATED_NGRAMS = {n: (20 - n) / 100 for n in range(5, 11)}
POLICY = tuple("privacy policy|cookie policy|terms of use|use cookies|uses cookies|use of cookies".split("|"))


def gopher_quality(
    text: Column, min_words: int | None = 50, max_words: int | None = 100_000, min_mean: float | None = 3, max_mean: float | None = 10, max_symbols: float | None = 0.1,
    max_bullets: float | None = 0.9, max_ellipses: float | None = 0.3, min_alpha: float | None = 0.8, need_stop_words: int | None = 2,
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS, splitter: Callable[[Column], Column] = T.split_words,
) -> Column:
    """Length, symbol, line and stop-word rules. Ratios are of all words, lengths of words that aren't punctuation alone. A text of punctuation alone has no mean length:
    if min_words is off it passes the mean-length rules."""

    def of(words: Column, content: Column, lines: Column, mean: Column) -> Column:
        n, c, rows = F.size(words), F.size(content), F.size(lines)
        share = lambda lines_like: F.size(F.filter(lines, lines_like)) / rows
        return first_reason([
            ("gopher_short_doc", n == 0),
            ("gopher_short_doc", c < min_words if min_words else None),
            ("gopher_long_doc", c > max_words if max_words else None),
            ("gopher_below_avg_threshold", mean < min_mean if min_mean else None),
            ("gopher_above_avg_threshold", mean > max_mean if max_mean else None),
            ("gopher_too_many_hashes", T.count_of(text, "#") / n > max_symbols if max_symbols else None),
            ("gopher_too_many_ellipsis", (T.count_of(text, "...") + T.count_of(text, "…")) / n > max_symbols if max_symbols else None),
            ("gopher_too_many_bullets", share(lambda x: T.let(T.lstrip(x), lambda y: y.startswith("•") | y.startswith("-"))) > max_bullets if max_bullets else None),
            ("gopher_too_many_end_ellipsis", share(lambda x: T.let(T.rstrip(x), lambda y: y.endswith("...") | y.endswith("…"))) > max_ellipses if max_ellipses else None),
            ("gopher_below_alpha_threshold", F.size(F.filter(words, lambda w: T.begins_letter(w) | w.rlike(r"\p{L}"))) / n < min_alpha if min_alpha else None),
            ("gopher_not_enough_stop_words", F.size(F.array_intersect(words, F.array(*map(F.lit, stop_words)))) < need_stop_words if need_stop_words else None),
        ])

    lines = T.let(T.split_lines(text), lambda x: F.when(F.size(x) == 0, F.array(text)).otherwise(x))
    content = lambda words: F.filter(words, lambda w: T.begins_alnum(w) | w.rlike(f"[^{T.MARK_CLASS}]"))
    mean = lambda c: T.chars(c) / F.nullif(F.size(c), F.lit(0))
    return T.let(splitter(text), lambda w: T.let(content(w), lambda c: T.let(lines, lambda x: T.let(mean(c), partial(of, w, c, x)))))


def duplicates(items: Column) -> tuple[Column, Column]:
    """How many items equal an earlier one, and their characters."""
    distinct = F.array_distinct(items)
    return F.size(items) - F.size(distinct), T.chars(items) - T.chars(distinct)


def repetition_lines(text: Column, lines: float | None = 0.3, paragraphs: float | None = 0.3, line_chars: float | None = 0.2, paragraph_chars: float | None = 0.2) -> Column:
    """The paragraph and line rules of the Gopher repetition filter."""
    size = F.length(text)

    def of(paras: Column, rows: Column) -> Column:
        (np, cp), (nl, cl) = duplicates(paras), duplicates(rows)
        return first_reason([
            ("dup_para_frac", np / F.size(paras) > paragraphs if paragraphs else None),
            ("dup_para_char_frac", cp / size > paragraph_chars if paragraph_chars else None),
            ("dup_line_frac", nl / F.size(rows) > lines if lines else None),
            ("dup_line_char_frac", cl / size > line_chars if line_chars else None),
        ])

    worded = F.filter(T.split_lines(text), lambda x: ~T.blank(x))
    rest = T.let(F.split(T.strip(text), r"\n{2,}"), lambda p: T.let(worded, partial(of, p)))
    return F.when(T.blank(text), "empty").otherwise(rest)


def top_ngram(words, n: int):
    """Characters of the commonest n-gram (first seen among equals), spaces between its words included, times its count."""
    counts: dict[tuple, int] = {}
    for k in range(len(words) - n + 1):
        gram = tuple(words[k : k + n])
        counts[gram] = counts.get(gram, 0) + 1
    if not counts:
        return 0
    best = max(counts, key=counts.__getitem__)
    return counts[best] * (n - 1 + sum(len(w) for w in best))


def repeated_ngrams(words, n: int):
    """Characters of n-grams seen before, scanning left to right and leaping over each that is counted."""
    known, total, k = set(), 0, 0
    while k + n <= len(words):
        gram = tuple(words[k : k + n])
        if gram in known:
            total += sum(len(w) for w in gram)
            k += n
            continue
        known.add(gram)
        k += 1
    return total


#: Words that are worked on at once, so that tables of n-grams stay in the processor's cache whatever a batch holds; a longer document is alone.
SLICE = 200_000


def _slices(words: pa.Array):
    """(first document, _Grams) of runs of documents with about SLICE words."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield at, _Grams(words.slice(at, to - at))
        at = to


class _Grams:
    """n-grams of some documents as numbers, for n = 1, 2, ... in turn: equal numbers are equal words of one document. Numbers are given in the order of first places, so those of a document follow
    each other. Everything is exact (no hashes) and takes time in proportion to the words."""

    def __init__(self, words: pa.Array):
        per = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        self.documents, self.n = len(words), 1
        self.doc, self.word = np.repeat(np.arange(len(words)), per), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = len(coded.dictionary)
        sizes = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[self.word]
        self.before = np.concatenate([[0], np.cumsum(sizes)])  # characters of words before each
        self.at, self.gram = np.arange(len(self.word)), self._number(self.doc * self.vocabulary + self.word)

    @staticmethod
    def _number(keys: np.ndarray) -> np.ndarray:
        return pa.array(keys).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def widen(self) -> None:
        """From n-grams to (n + 1)-grams: a number and the word after it."""
        last = self.at + self.n
        fits = last < len(self.word)
        fits[fits] = self.doc[last[fits]] == self.doc[self.at[fits]]
        self.at, last = self.at[fits], last[fits]
        self.gram = self._number(self.gram[fits] * self.vocabulary + self.word[last])
        self.n += 1

    def keep(self, wanted: np.ndarray) -> None:
        """Only documents for which `wanted` is true go on."""
        stays = wanted[self.doc[self.at]]
        self.at, self.gram = self.at[stays], self._number(self.gram[stays])

    def chars(self, at: np.ndarray) -> np.ndarray:
        return self.before[at + self.n] - self.before[at]

    def firsts(self) -> np.ndarray:
        """Whether each place is the first of its n-gram."""
        seen = np.maximum.accumulate(self.gram)
        return np.diff(seen, prepend=-1) > 0

    def top(self) -> np.ndarray:
        """top_ngram of each document."""
        out = np.zeros(self.documents, np.int64)
        if len(self.gram):
            first = self.at[self.firsts()]
            docs, starts = np.unique(self.doc[first], return_index=True)
            best = np.maximum.reduceat((np.bincount(self.gram) << 32) - first, starts)
            count = -(-best >> 32)
            out[docs] = count * (self.n - 1 + self.chars((count << 32) - best))
        return out

    def repeated(self, chars: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """For each document whether repeated_ngrams are over `most` of its characters, and whether any n-gram repeats. The scan, which has state, runs only where all places but first ones together are over it."""
        over, again = np.zeros(self.documents, bool), ~self.firsts()
        docs = self.doc[self.at]
        bound = np.bincount(docs[again], self.chars(self.at[again]), self.documents)
        for k in np.flatnonzero(bound / chars > most):
            a, b = np.searchsorted(docs, (k, k + 1))
            over[k] = _scan(self.gram[a:b].tolist(), self.chars(self.at[a:b]).tolist(), self.n) / chars[k] > most
        return over, np.bincount(docs[again], minlength=self.documents) > 0


def _scan(grams: list[int], chars: list[int], n: int) -> int:
    """repeated_ngrams of numbered n-grams."""
    known, total, k = set(), 0, 0
    while k < len(grams):
        if grams[k] in known:
            total += chars[k]
            k += n
        else:
            known.add(grams[k])
            k += 1
    return total


def top_ngrams(words: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """array<bigint>: top_ngram of each size in rising order, null where there are too few words."""

    @F.arrow_udf("array<long>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = [np.zeros(len(batch), np.int64) for _ in sizes]
            for at, grams in _slices(batch):
                for n, column in zip(sizes, columns, strict=True):
                    while grams.n < n:
                        grams.widen()
                    column[at : at + grams.documents] = grams.top()
            per = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
            values = np.stack(columns, axis=1).reshape(-1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(sizes), pa.int32()), pa.array(values, mask=(per[:, None] < np.array(sizes)).reshape(-1)))

    return measured(words)


def _ngram_reasons(words: pa.Array, size: np.ndarray, top: dict[int, float], duplicated: dict[int, float]) -> list[str | None]:
    out: list[str | None] = [None] * len(words)
    for at, grams in _slices(words):
        chars, undecided = np.maximum(size[at : at + grams.documents], 1), np.ones(grams.documents, bool)
        for kind, rules in (("top", top), ("duplicated", duplicated)):
            for n, most in rules.items():
                if n < grams.n:  # sizes that don't rise
                    grams = _Grams(words.slice(at, grams.documents))
                while grams.n < n:
                    grams.widen()
                over, longer = (grams.top() / chars > most, True) if kind == "top" else grams.repeated(chars, most)
                for k in np.flatnonzero(over & undecided):
                    out[at + k] = f"top_{n}_gram" if kind == "top" else f"duplicated_{n}_n_grams"
                undecided &= ~over
                grams.keep(undecided & longer)
    return out


def repetition_ngrams(text: Column, top: dict[int, float] = TOP_NGRAMS, duplicated: dict[int, float] = DUPLICATED_NGRAMS, split: Callable[[str], list[str]] | None = None) -> Column:
    """The n-gram rules. The greedy scan has state, so it runs in an Arrow function; words are split on the JVM side, or by `split`. A null text gives null."""

    @F.arrow_udf("string")
    def reason(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for words, size in batches:
            if split is not None:
                words = pa.array([None if t is None else split(t) for t in words.to_pylist()], pa.list_(pa.string()))
            yield pa.array(_ngram_reasons(words, pc.fill_null(size, 0).to_numpy(zero_copy_only=False), top, duplicated), pa.string())

    return reason(F.when(F.length(text) > 0, T.split_words(text) if split is None else text), F.length(text))


def repetition_steps(top: dict[int, float] = TOP_NGRAMS, duplicated: dict[int, float] = DUPLICATED_NGRAMS, split: Callable[[str], list[str]] | None = None, name: str = "gopher repetition", **options) -> list[Step]:
    """All repetition rules, as two steps of one name: the n-gram rules see only texts that the native rules keep."""
    return [Step(name, lambda _: repetition_lines(F.col("text"), **options)), Step(name, lambda _: repetition_ngrams(F.col(ALIVE_TEXT), top, duplicated, split), python=True)]


def fineweb_quality(
    text: Column, min_ended: float | None = 0.12, allow_none_ended: bool = False, max_short: float | None = 0.67, short: int = 30, max_duplicate_chars: float | None = 0.01,
    max_breaks: float | None = 0.3, splitter: Callable[[Column], Column] = T.split_words,
) -> Column:
    """Line rules: ends of sentences, short lines, repeated lines, line breaks per word."""

    def of(rows: Column) -> Column:
        n, ended = F.size(rows), F.size(F.filter(rows, T.ends_sentence))
        low = None
        if min_ended is not None:
            low = (ended / n < min_ended) & ((ended > 0) | F.lit(not allow_none_ended))
        return first_reason([
            ("empty", n == 0),
            ("line_punct_ratio", low),
            ("short_line_ratio", F.size(F.filter(rows, lambda x: F.length(x) <= short)) / n > max_short if max_short is not None else None),
            ("char_dup_ratio", duplicates(rows)[1] / F.length(F.replace(text, F.lit("\n"), F.lit(""))) > max_duplicate_chars if max_duplicate_chars is not None else None),
            ("list_ratio", T.count_of(text, "\n") / F.greatest(F.size(splitter(text)), F.lit(1)) > max_breaks if max_breaks is not None else None),
        ])

    return T.let(F.filter(F.split(text, "\n"), lambda x: ~T.blank(x)), of)


def c4_lines(text: Column, terminal: bool = True, min_words: int | None = 3, max_word: int | None = 1000, citations: bool = True, lorem: bool = True, javascript: bool = True, curly: bool = True, policy: bool = True) -> Column:
    """array<struct<line, action>>: each line, stripped and without citations, and what becomes of it: keep, a reason to drop the line, or lorem_ipsum or
    curly_bracket, which drop the document."""

    space, ends = f"[{T.SPACE}]", (".", "?", "!", '"', "'")

    def of(raw: Column) -> Column:
        # A dear pattern is asked only where a cheap condition leaves it open, and is never tried again from places that it has passed.
        line = F.when(raw.contains("["), F.regexp_replace(raw, r"\[[0-9]*\]|\[edit\]|\[citation needed\]", "")).otherwise(raw) if citations else raw
        enough = raw.rlike(rf"\A{space}*+(?:[^{T.SPACE}]++{space}++){{{min_words - 1}}}[^{T.SPACE}]") if min_words else None

        def judged(x: Column, lower: Column) -> Column:
            action = first_reason([
                ("too_long_word", (F.length(raw) > max_word) & raw.rlike(rf"(?<![^{T.SPACE}])[^{T.SPACE}]{{{max_word + 1}}}") if max_word is not None else None),
                ("no_terminal_punct", ~reduce(or_, map(x.endswith, ends)) | x.endswith("...") if terminal else None),
                ("too_few_words", ~enough if min_words else None),
                ("lorem_ipsum", lower.contains("lorem ipsum") if lorem else None),
                ("javascript", lower.contains("javascript") if javascript else None),
                ("curly_bracket", x.contains("{") if curly else None),
                ("policy", reduce(or_, map(lower.contains, POLICY)) if policy else None),
            ])
            return F.struct(x.alias("line"), F.coalesce(action, F.lit("keep")).alias("action"))

        return T.let(line, lambda x: T.let(F.lower(x), partial(judged, x)))

    return F.transform(F.transform(T.split_lines(text), T.strip), of)


def c4_verdict(text: Column, min_sentences: int | None = 5, **rules) -> Column:
    """struct<reason, text>: the document's reason to go, or its text of surviving lines."""

    def of(lines: Column) -> Column:
        fatal = F.get(F.filter(lines, lambda x: x["action"].isin("lorem_ipsum", "curly_bracket")), F.lit(0))["action"]
        left = F.transform(F.filter(lines, lambda x: x["action"] == "keep"), lambda x: x["line"])
        sentences = F.aggregate(left, F.lit(0), lambda a, x: a + T.count_sentences(x))
        few = F.when(sentences < min_sentences, "too_few_sentences") if min_sentences is not None else F.lit(None).cast("string")
        return F.struct(F.coalesce(fatal, few).alias("reason"), T.strip(F.array_join(left, "\n")).alias("text"))

    return T.let(c4_lines(text, **rules), of)


def url_filter(
    url: Column, domains: Iterable[str] = (), urls: Iterable[str] = (), banned: Iterable[str] = (), soft: Iterable[str] = (), soft_threshold: int = 2, subwords: Iterable[str] = (),
    suffixes: Iterable[str] = ("com", "org", "net", "edu", "gov", "co.uk", "org.uk", "com.au", "co.in"),
) -> Column:
    """URL rules. The registrable domain is one label more than the longest suffix listed that ends the host (or than the last label). Lists are sets of literals: for lists of millions of
    domains use url_lists_filter."""
    one = lambda xs: F.array(*map(F.lit, sorted(xs))).cast("array<string>")
    words = F.array_distinct(F.split(F.lower(url), "[^a-z0-9]+"))
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    compact = F.regexp_replace(F.lower(url), "[^a-z0-9]+", "")
    return first_reason([
        ("missing_url", url.isNull() | (url == "")),
        ("domain", registrable(host, suffixes).isin(*domains) if domains else None),
        ("subdomain", host.isin(*domains) if domains else None),
        ("url", F.regexp_replace(url, r"^.*?://", "").isin(*urls) if urls else None),
        ("banned_word", F.arrays_overlap(words, one(banned)) if banned else None),
        ("soft_banned_words", F.size(F.array_intersect(words, one(soft))) >= soft_threshold if soft else None),
        ("banned_subword", F.exists(one(subwords), lambda s: F.contains(compact, s)) if subwords else None),
    ])


def registrable(host: Column, suffixes: Iterable[str]) -> Column:
    listed = "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=lambda s: (-s.count("."), s)))
    found = F.regexp_extract(host, rf"([^.]+\.(?:{listed}))\z", 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(host, r"([^.]+\.[^.]+)\z", 1))


def url_lists_filter(docs, lists, url_col: str = "url"):
    """docs with list_reason from a table (kind, entry) of any size, kind being domain or url: two joins that Spark broadcasts only if the table is small."""
    host, bare = F.lower(F.try_parse_url(F.col(url_col), F.lit("HOST"))), F.regexp_replace(F.col(url_col), r"^.*?://", "")
    parents = F.transform(F.sequence(F.lit(0), F.regexp_count(host, F.lit(r"\."))), lambda i: F.call_function("substring_index", host, F.lit("."), -(i + 1)))
    rows = docs.withColumn("__key", F.xxhash64(F.col(url_col)))
    named = rows.select("__key", F.explode(F.coalesce(parents, F.array().cast("array<string>"))).alias("entry")).join(lists.where("kind = 'domain'").select("entry").distinct(), "entry").select("__key", F.lit("domain").alias("r"))
    exact = rows.select("__key", bare.alias("entry")).join(lists.where("kind = 'url'").select("entry").distinct(), "entry").select("__key", F.lit("url").alias("r"))
    hit = named.union(exact).groupBy("__key").agg(F.min("r").alias("list_reason"))
    return rows.join(hit, "__key", "left").drop("__key")


def crawl_language(tags: Column, languages: Iterable[str]) -> Column:
    """Documents without language tags stay; tagged ones need a wanted tag."""
    return F.when((F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0) & ~F.arrays_overlap(tags, F.array(*map(F.lit, languages))), "other_language")


def language(scores: Column, languages: Iterable[str], threshold: dict[str, float] | float = 0.65) -> tuple[Column, Column, Column]:
    """(reason, language, score) from a map of language scores; the best language is written down even for documents that go. Ties: the lower name. A wanted language without a threshold of its own has 0.65."""
    best = F.get(F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k")))), F.lit(0))
    name, score = best["k"], F.bround(-best["s"], 4)
    least = F.lit(threshold) if isinstance(threshold, float) else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in threshold.items() for x in kv]), name), F.lit(0.65))
    return first_reason([("other_language", name.isNull() | ~name.isin(*languages)), ("low_confidence", -best["s"] < least)]), name, score


def telugu_steps() -> list[Step]:
    """Repetition, line and quality rules tuned for Telugu."""
    indic, text = T.split_indic_words, F.col("text")
    top = dict(zip(range(2, 5), (0.21, 0.18, 0.162), strict=True))
    repeated = {n: v / 1000 for n, v in zip(range(5, 11), (142, 133, 122, 114, 105, 96), strict=True)}
    return [
        *repetition_steps(top, repeated, T.indic_words, lines=0.256, paragraphs=None, line_chars=None, paragraph_chars=None),
        Step("fineweb quality", lambda _: fineweb_quality(text, 0.08, max_short=None, max_duplicate_chars=0.1, max_breaks=0.18, splitter=indic)),
        Step("gopher quality", lambda _: gopher_quality(text, min_mean=4, max_mean=68, min_alpha=0.739, stop_words=TELUGU_STOP_WORDS, splitter=indic)),
    ]
