"""Reasons of each rule, on small texts."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import filters, formatters
from corpusmill.operators.extract import extract, main_text
from corpusmill.operators.verdict import Step, apply_steps, funnel, kept, removed

GOOD = "The people of this old town have lived with the river for ages, and they know that it will be high in spring. They built strong walls to keep it out of the fields. Most of them still grow wheat and beans there. In winter the children walk to school over the bridge, which was made of stone long ago. It is said that the bridge will stand for a thousand years more."


def reasons(spark, column, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.x for r in rows.select("id", column(F.col("text")).alias("x")).orderBy("id").collect()]


def test_gopher_quality(spark):
    words = GOOD.split()
    cases = {
        GOOD: None, "": "gopher_short_doc", "a few words": "gopher_short_doc", " ".join(["a1"] * 60): "gopher_below_avg_threshold", " ".join(["extraordinarily"] * 60): "gopher_above_avg_threshold",
        GOOD + " #" * 12: "gopher_too_many_hashes", "… " * 12 + GOOD: "gopher_too_many_ellipsis", "\n".join("- " + w for w in words): "gopher_too_many_bullets", "\n".join(" ".join(words[k : k + 12]) + ("..." if k < 36 else ".") for k in range(0, 72, 12)): "gopher_too_many_end_ellipsis",
        " ".join(f"{w} 12345" for w in words): "gopher_below_alpha_threshold", GOOD.upper(): "gopher_not_enough_stop_words",
    }
    assert reasons(spark, filters.gopher_quality, *cases) == list(cases.values())
    assert reasons(spark, lambda t: filters.gopher_quality(t, min_words=None, min_mean=None, max_mean=None, min_alpha=None, need_stop_words=None), "!!! ???", "") == [None, "gopher_short_doc"]
    assert reasons(spark, lambda t: filters.gopher_quality(t, max_words=20), GOOD) == ["gopher_long_doc"]


def test_repetition(spark):
    para = "one two three four\n\n"
    lines = GOOD.replace(". ", ".\n")
    cases = {" \n": "empty", para * 3 + "five six seven": "dup_para_frac", "x y z w\n" * 3 + "other": "dup_line_frac", lines + "\n" + lines.split("\n")[0]: None if len(lines.split("\n")[0]) < 0.2 * len(lines) else "dup_line_char_frac"}
    assert reasons(spark, filters.repetition_lines, *cases) == list(cases.values())
    docs = spark.createDataFrame([(1, GOOD), (2, "spam ham " * 40), (3, "a b\nc d"), (4, " ".join(f"w{k % 30} v{k}" for k in range(120))), (5, "")], "id int, text string")
    got = {r.id: r.drop_reason for r in apply_steps(docs, filters.repetition_steps()).collect()}
    assert got[1] is None and got[2] == "top_2_gram" and got[5] == "empty" and got[3] == "top_2_gram"


def test_ngram_measures():
    assert filters.top_ngram("a b a b c".split(), 2) == 2 * (2 + 1)
    assert filters.top_ngram(["x", "yy", "zzz"], 2) == 4 and filters.top_ngram(["x"], 2) == 0  # first seen among equals
    assert filters.repeated_ngrams("a b c a b c a b c".split(), 3) == 6 and filters.repeated_ngrams("a b".split(), 3) == 0


def test_numbered_ngrams_equal_plain_scans(monkeypatch):
    """Documents that lie in one slice, share words, are empty, null or longer than a slice."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    docs = [[rng.choice(["a", "bb", "ccc", "é", "’"][: rng.randint(1, 5)]) for _ in range(rng.choice([0, 1, 3, 9, 40, 150]))] for _ in range(150)] + [None, "x y z w v u t s r q".split() * 3]
    top, repeated = {2: 0.2, 3: 0.18, 4: 0.16}, {5: 0.4, 7: 0.1, 6: 0.05, 10: 0.02}
    sizes = [3 * len(w or ()) + 1 for w in docs]

    def reason(w, chars):
        for n, most in top.items():
            if filters.top_ngram(w, n) / chars > most:
                return f"top_{n}_gram"
        for n, most in repeated.items():
            if filters.repeated_ngrams(w, n) / chars > most:
                return f"duplicated_{n}_n_grams"

    want = [None if w is None else reason(w, c) for w, c in zip(docs, sizes, strict=True)]
    assert len(set(want)) > 4
    for size in (1, 60, 10**6):
        monkeypatch.setattr(filters, "SLICE", size)
        words = pa.array([["other"], *docs], pa.list_(pa.string()))[1:]
        assert filters._ngram_reasons(words, np.array(sizes), top, repeated) == want
        for n in (2, 3, 4):
            got = []
            for _, grams in filters._slices(words):
                while grams.n < n:
                    grams.widen()
                got += grams.top().tolist()
            assert got == [filters.top_ngram(w or [], n) for w in docs]


def test_fineweb(spark):
    long = "This line has certainly more than thirty characters"
    cases = {"\n \n": "empty", "\n".join([long] * 9): "line_punct_ratio", "Short.\nLines.\nHere.": "short_line_ratio", f"{long}.\n{long}.\nAnd then there is one that differs from them.": "char_dup_ratio", GOOD: None, "a1234567890123456789012345678901.\n" + "\n" * 9: "list_ratio", "यह एक बहुत लंबा वाक्य है जो यहाँ समाप्त होता है।": None}
    assert reasons(spark, filters.fineweb_quality, *cases) == list(cases.values())
    assert reasons(spark, lambda t: filters.fineweb_quality(t, allow_none_ended=True, max_short=None), long) == [None]


def test_c4(spark):
    five = "\n".join(f"This is sentence number {k}." for k in range(5))
    cases = {
        five: (None, five), five + "\nno end here": (None, five), five + "\nIt trails off...": (None, five), five + "\nToo short.": (None, five), five + "\nPlease enable JavaScript { now.": (None, five),
        five + "\nWe say lorem ipsum here.": ("lorem_ipsum", None), five + "\nA curly { is bad here.": ("curly_bracket", None), five + "\nRead our Privacy Policy now.": (None, five), five + "\n" + "x" * 1001 + " a b c.": (None, five),
        "Only one sentence here.": ("too_few_sentences", None), five.replace("number", "number[12] [edit]"): (None, five.replace("number", "number ")), "": ("too_few_sentences", None),
    }
    for got, want in zip(reasons(spark, filters.c4_verdict, *cases), cases.values(), strict=True):
        assert got.reason == want[0] and (want[1] is None or got.text == want[1])
    assert reasons(spark, lambda t: filters.c4_verdict(t, terminal=False), five + "\nno end here")[0].text.endswith("no end here")


def test_urls(spark):
    options = dict(domains=["bad.com", "sub.fine.org"], urls=["x.org/page"], banned=["casino"], soft=["free", "win"], subwords=["xxx"])
    cases = {None: "missing_url", "": "missing_url", "http://a.bad.com/": "domain", "https://sub.fine.org/a": "subdomain", "https://x.org/page": "url", "http://ok.com/casino-night": "banned_word", "http://ok.com/free/win": "soft_banned_words", "http://ok.com/a-xx-x": "banned_subword", "http://ok.com/free": None, "http://notbad.com/": None}
    assert reasons(spark, lambda u: filters.url_filter(u, **options), *cases) == list(cases.values())
    lists = spark.createDataFrame([("domain", "bad.com"), ("url", "x.org/page")], "kind string, entry string")
    docs = spark.createDataFrame([(u,) for u in ("http://a.bad.com/", "https://x.org/page", "http://ok.com/", None)], "url string")
    assert sorted((str(r.url), r.list_reason) for r in filters.url_lists_filter(docs, lists).collect()) == [("None", None), ("http://a.bad.com/", "domain"), ("http://ok.com/", None), ("https://x.org/page", "url")]


def test_languages(spark):
    rows = spark.createDataFrame([(1, {"en": 0.9, "fr": 0.1}), (2, {"en": 0.6, "fr": 0.4}), (3, {"de": 0.99}), (4, {}), (5, {"fr": 0.70004})], "id int, s map<string,double>")
    reason, name, score = filters.language(F.col("s"), ["en", "fr"], {"en": 0.65, "fr": 0.8})
    got = [tuple(r) for r in rows.select(reason, name, score, "id").orderBy("id").collect()]
    assert got == [(None, "en", 0.9, 1), ("low_confidence", "en", 0.6, 2), ("other_language", "de", 0.99, 3), ("other_language", None, None, 4), ("low_confidence", "fr", 0.7, 5)]
    tags = spark.createDataFrame([(1, ["en"]), (2, ["de", "en"]), (3, ["de"]), (4, []), (5, None)], "id int, t array<string>")
    assert [r[0] for r in tags.select(filters.crawl_language(F.col("t"), ["en"]), "id").orderBy("id").collect()] == [None, None, "other_language", None, None]


def test_telugu_steps_run(spark):
    docs = spark.createDataFrame([("ఈ గ్రామం నుండి దూరంలో ఉంది ।\n" * 30,), ("",)], "text string")
    got = [r.drop_step for r in apply_steps(docs, filters.telugu_steps()).collect()]
    assert got == ["gopher repetition"] * 2


def test_chain_and_funnel(spark):
    docs = spark.createDataFrame([(1, "keep me"), (2, "bad"), (3, "   x"), (4, "### \n***"), (5, "bad")], "id int, text string")
    steps = [Step("first", lambda d: F.when(F.col("text") == "bad", "is_bad")), Step("format", rewrite=formatters.symbol_lines, formatter=True), Step("last", lambda d: F.when(F.col("text").contains("x"), "has_x"))]
    out = apply_steps(docs, steps)
    assert {r.id: (r.drop_step, r.drop_reason) for r in out.collect()} == {1: (None, None), 2: ("first", "is_bad"), 5: ("first", "is_bad"), 3: ("last", "has_x"), 4: ("format", "dropped_empty")}
    assert [r.id for r in kept(out).collect()] == [1] and removed(out).columns[-2:] == ["step", "filter_reason"]
    rows = {(r.step, r.label): (r.value, r.share) for r in funnel(out, ["first", "format", "last"]).collect()}
    assert rows["first", "total"] == (5, 1.0) and rows["first", "dropped_is_bad"] == (2, 0.4) and rows["format", "total"] == (3, 1.0) and rows["last", "forwarded"] == (1, 0.5)
    assert funnel(apply_steps(docs.where("false"), steps), ["first"]).where("value <> 0").count() == 0


def test_funnel_reads_the_documents_once(spark, tmp_path):
    spark.createDataFrame([(1, "keep me"), (2, "bad")], "id int, text string").write.parquet(str(tmp_path / "docs"))
    verdicts = apply_steps(spark.read.parquet(str(tmp_path / "docs")), [Step("first", lambda d: F.when(F.col("text") == "bad", "is_bad"))])
    rows = funnel(verdicts, ["first"])
    assert verdicts.inputFiles() and not set(verdicts.inputFiles()) & set(rows.inputFiles())  # what is left works on the counts
    assert {(r.label, r.value) for r in rows.collect()} == {("total", 2), ("forwarded", 1), ("dropped", 1), ("dropped_is_bad", 1)}


def test_rules_take_linear_time(spark):
    """Long runs of white space within a line, and lines of one long word."""
    import time

    began = time.time()
    gap = "This line ends" + " " * 200_000 + "here."
    got = reasons(spark, lambda t: F.transform(filters.c4_lines(t), lambda x: F.struct(F.length(x["line"]), x["action"])), f"  {gap}\nxy\n{'x' * 300_000}", "a b.\n a b c.")
    assert [[tuple(x) for x in r] for r in got] == [[(len(gap), "keep"), (2, "no_terminal_punct"), (300_000, "too_long_word")], [(4, "too_few_words"), (6, "keep")]]
    assert reasons(spark, filters.repetition_lines, gap) == [None] and time.time() - began < 30


def test_symbol_lines(spark):
    text = "a\n***\n---\n\nb\n»"
    assert reasons(spark, formatters.symbol_lines, text, "only") == ["a\n\nb", "only"]
    assert reasons(spark, lambda t: formatters.symbol_lines(t, paragraph_break=True), text) == ["a\n\n\nb\n"]


def test_pii(spark):
    text = "mail a.b+c@d-e.co.uk or A@B.com, ip 8.8.8.8 and 10.0.0.1, not 1.2.3.4.5 nor 300.1.1.1"
    (one, two, same) = reasons(spark, formatters.mask_pii, text, "nothing 3.5", text)
    assert one == same and two == "nothing 3.5" and "d-e" not in one and "10.0.0.1" in one and "8.8.8.8" not in one and "1.2.3.4.5" in one and "300.1.1.1" in one
    assert "10.0.0.1" not in reasons(spark, lambda t: formatters.mask_pii(t, public_only=False), text)[0]
    assert reasons(spark, formatters.mask_pii_constant, "x a@b.com 1.1.1.1", None) == ["x email@example.com 192.0.2.1", None]


def test_fix_text(spark):
    assert formatters.fix_text("schÃ¶n &amp; gut") == "schön & gut" and formatters.fix_text("a &amp; <b>") == "a &amp; <b>"
    assert formatters.fix_text("é ﬁ “q” １\x07") == "é ﬁ “q” １" and formatters.fix_text("à la carte é") == "à la carte é"
    assert reasons(spark, formatters.fix_encoding, "cafÃ©", None) == ["café", None] and reasons(spark, formatters.flatten, " a\nb\r\nc ") == ["a b c"]
    assert formatters.preview("a  b\n" * 200, 5) == "a b…" and formatters.preview("ée", 2) == "ée"


PAGE = "<html><head><style>p{}</style><script>var x='</p>';</script></head><body><nav><a>Home</a></nav><article><h1>Title</h1><p>First &amp; only <b>line</b>.</p><div class='advert'>Buy</div><p>Second.</p><p>Second.</p></article><footer>End</footer></body></html>"


def test_extract(spark):
    assert main_text(PAGE) == "Title\nFirst & only line.\nSecond." and main_text("<p>x") == "x" and main_text("") is None
    import time

    def slow(page):
        if page == "slow":
            time.sleep(5)
        if page == "bad":
            raise RuntimeError
        return main_text(page)

    rows = spark.createDataFrame([(1, PAGE), (2, "slow"), (3, "bad"), (4, ""), (5, None), (6, "<p>y")], "id int, h string").coalesce(1)
    got = {r.id: (r.x.text, r.x.status) for r in rows.select("id", extract(F.col("h"), slow, 0.3).alias("x")).collect()}
    assert got == {1: (main_text(PAGE), "forwarded"), 2: (None, "timeout"), 3: (None, "extraction_error"), 4: (None, "dropped"), 5: (None, "dropped"), 6: ("y", "forwarded")}


@pytest.mark.parametrize("parts", [1, 4])
def test_verdicts_do_not_depend_on_partitions(spark, sf, parts):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(parts)
    got = {r.doc_id: r.r for r in docs.select("doc_id", filters.gopher_quality(F.col("text")).alias("r")).collect()}
    assert got == {r.doc_id: r.r for r in docs.coalesce(1).select("doc_id", filters.gopher_quality(F.col("text")).alias("r")).collect()}
