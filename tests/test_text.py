"""Column functions against plain Python."""

import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as T

ALPHABET = "abZ é'’.,!?…-–(#1٣ \t\n\r\x0b\x0c\x1c\x85\xa0 　“”•_ǅ日।"
TEXTS = st.lists(st.text(ALPHABET, max_size=40), min_size=30, max_size=60)
QUIET = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def both(spark, texts, column, python):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", column(F.col("text")).alias("x")).collect()
    for r in rows:
        assert r.x == python(r.text), repr(r.text)


def simplify(t):
    t = regex.sub(r"\p{Nd}+(?:[,.]\p{Nd}+)*", "0", t.lower())
    return regex.sub(r"\s+", " ", regex.sub(r"\p{P}+", " ", t)).strip()


@QUIET
@given(TEXTS)
def test_split_words(spark, texts):
    both(spark, texts, T.split_words, regex.compile(r"[\p{M}\w]+(?:['’][\p{M}\w]+)*|[^\p{M}\w\s]").findall)


@QUIET
@given(TEXTS)
def test_simplify_and_strip(spark, texts):
    both(spark, texts, T.simplify_text, simplify)
    both(spark, texts, T.strip, str.strip)
    both(spark, texts, T.simple_words, lambda t: simplify(t).split())


@QUIET
@given(TEXTS)
def test_lines_and_ends(spark, texts):
    both(spark, texts, T.split_lines, str.splitlines)
    both(spark, texts, T.blank, lambda t: not t.strip())
    both(spark, texts, T.ends_sentence, lambda t: bool(regex.search(r"\p{Sentence_Terminal}$", t.rstrip())))


@QUIET
@given(st.lists(st.text("12 ,.:/a।-", max_size=30), min_size=30, max_size=40))
def test_indic_words(spark, texts):
    def python(t):
        t = regex.sub(r"[ \t]+", " ", regex.sub("([" + regex.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + "।॥])", r" \1 ", t))
        t = regex.sub(r"[0-9]+(?: [,.:/] [0-9]+)+", lambda m: m[0].replace(" ", ""), t)
        return [w.strip() for w in t.split(" ") if w.strip()]

    both(spark, texts, T.split_indic_words, python)
    assert [T.indic_words(t) for t in texts] == [python(t) for t in texts]


def test_ngrams_counts_and_hosts(spark):
    row = spark.createDataFrame([("a bb c d", "a...b...", "https://WWW.Blog.Example.com:8080/x?y#z")], "t string, d string, u string")
    got = row.select(T.ngrams(F.split("t", " "), 3).alias("g"), T.ngrams(F.split("t", " "), 9).alias("none"), T.count_of(F.col("d"), "...").alias("n"), T.host_of(F.col("u")).alias("h"), T.origin_of(F.col("u")).alias("o")).first()
    assert tuple(got) == (["a bb c", "bb c d"], [], 2, "blog.example.com", "https://www.blog.example.com:8080")
    assert T.hash64("x") == T.hash64("x") < 2**64
    both(spark, ["One. Two? Three", "", "v1.2 is out", "Dr. who"], T.count_sentences, {"One. Two? Three": 3, "": 0, "v1.2 is out": 1, "Dr. who": 2}.get)


def test_ends_and_first_characters_as_patterns_have_them(spark):
    import regex

    assert {chr(k) for k in range(0x110000) if chr(k).isspace()} == set(T.SPACES)
    odd = ["", " ", "\u2003a b\x1f", "\x85\u3000", "a\u200b ", "Zz", "[a", "`a", "{", "@", "/", ":", "0", "9x", "é", "తె", "_a", "’n’"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "id int, t string").orderBy("id")
    got = rows.select(T.strip(F.col("t")), T.lstrip(F.col("t")), T.rstrip(F.col("t")), T.blank(F.col("t")), T.begins_alnum(F.col("t")), T.begins_letter(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(t.strip(), t.lstrip(), t.rstrip(), not t.strip(), bool(regex.match("[A-Za-z0-9]", t)), bool(regex.match("[A-Za-z]", t))) for t in odd]
    texts = ["a\n\nb\r\nc\n", "a\x1cb\u2028", "\n", "", "x", "\r", "a\n\r"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").orderBy("id")
    assert [r[0] for r in rows.select(T.split_lines(F.col("t"))).collect()] == [t.splitlines() for t in texts]
    mixed = ["a \t b", "a\tb", " a  b ", "a\u2003\u2003b c\n\nd", "a\x1cb  c"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(mixed)], "id int, t string").orderBy("id")
    assert [r[0] for r in rows.select(T.simplify_text(F.col("t"))).collect()] == ["a b", "a b", "a b", "a b c d", "a\x1cb c"]
    assert [r[0] for r in rows.select(T.simple_words(F.col("t"))).collect()] == [["a", "b"]] * 3 + [["a", "b", "c", "d"], ["a", "b", "c"]]
