import re
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.llm import chat, linededup, quality

from .helpers import PROSE, awkward, empty

STOP = set(quality.STOP_WORDS)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def measured(df):
    q = "quality."
    return df.select("text", *[q + k for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept", "base_failed", "reason")]).collect()


def test_measures_match_brute_force(spark, sf):
    made = ["a b c a b c", "a a a a a", "x # * $%&|<>\nx # * $%&|<>\n\n", "é ü ñ 😀😀 z", "a b c d a b c", "\r\n\r\n", "one\ttwo\x0bthree\x0cfour"]
    docs = spark.createDataFrame([(t,) for t in made], "text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("text"))
    for r in measured(quality.quality(docs)):
        assert tuple(r)[1:6] == brute(r.text), r.text[:60]


def test_awkward_rows_have_a_defined_verdict(spark):
    docs = awkward(spark)
    out = quality.quality(docs)
    assert out.count() == docs.count()
    for r in measured(out):
        if not (r.text or "").strip():
            assert r.base_failed and not r.kept and r.reason == "too_few_words"
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns and {r.text[:20] for r in kept.collect()} == {PROSE[:20]}
    assert quality.quality(empty(spark)).count() == 0 == quality.accepted(empty(spark)).count()


def test_each_rule_rejects(spark):
    cases = {
        "too_few_words": "the of and",
        "repeated_words": "the of and " * 40,
        "short_words": " ".join(chr(97 + k % 26) + str(k % 10) for k in range(60)),
        "long_words": " ".join("x" * 13 + str(k) for k in range(60)),
        "symbols": PROSE.replace(" ", "# "),
        "exclamations": PROSE.replace(" ", "! "),
        "few_stop_words": " ".join(f"word{k}" for k in range(99)),
        "repeated_lines": PROSE + "\n" + "\n".join(["solo"] * 30),
    }
    rows = spark.createDataFrame(list(cases.items()), "want string, text string")
    for r in quality.quality(rows).select("want", "quality.reason").collect():
        assert r.reason == r.want


def test_thresholds_are_a_parameter(spark):
    rows = spark.createDataFrame([("a b",), ("a b c",)], "text string")
    rules = (quality.Rule("three", "n_words", ">", 250),)
    assert [r.reason for r in quality.quality(rules=rules, base_rules=(quality.Rule("none", "n_words", "<", 100),), docs=rows).select("quality.reason").collect()] == [None, "three"]


def pages(spark):
    rows = [(k, f"menu\nunique {k}\nmenu" if k < 8 else f"unique {k}", "h") for k in range(20)] + [(100 + k, "menu\nother", "g") for k in range(3)]
    return spark.createDataFrame([*rows, (200, "menu", None), (201, None, "h"), (202, "", "h"), (203, "menu", "h"), (203, "menu", "h")], "doc_id long, text string, source string")


def test_line_dedup_drops_site_boilerplate_only(spark):
    for limit in (200_000, 0):  # broadcast, and the salted join
        got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.drop_boilerplate(pages(spark), percent=30, min_pages=5, broadcast_rows=limit).collect()}
        assert {(0, "unique 0", 3, 2), (8, "unique 8", 1, 0), (100, "menu\nother", 2, 0), (200, "menu", 1, 0), (201, None, 0, 0), (202, "", 1, 0), (203, "", 1, 1)} <= got
        assert linededup.drop_boilerplate(pages(spark), percent=30, broadcast_rows=limit).count() == pages(spark).count()


def test_line_dedup_awkward(spark):
    docs = awkward(spark)
    out = linededup.drop_boilerplate(docs, counts=None)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert linededup.drop_boilerplate(empty(spark)).count() == 0


def test_common_prefix_and_masks(spark):
    turn = lambda *xs: [{"role": r, "text": t} for r, t in xs]
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("assistant", "no 😀")
    cases = [
        (1, turn(a, b), turn(a, c), 1), (2, turn(a, b), turn(a, b), 2), (3, turn(a), turn(a, b), 1), (4, None, turn(a), 0), (5, [], [], 0), (6, turn(b, a, c), turn(a, a, c), 0),
        (7, turn(("user", None), (None, "x")), turn(("user", ""), ("", "x"), b), 2), (7, turn(a, b), turn(a, c), 1),
    ]
    kind = chat.TURNS
    out = chat.preference_pairs(spark.createDataFrame(cases, f"id long, chosen {kind}, rejected {kind}, want int")).collect()
    assert len(out) == len(cases)
    for r in out:
        assert r.prefix_turns == r.want
        for side, other in (("chosen", r.chosen), ("rejected", r.rejected)):
            whole = "".join(f"<|{t.role or ''}|>\n{t.text or ''}<|end|>\n" for t in other or [])
            assert r.prompt + r[f"{side}_text"] == whole
            assert [r[f"{side}_text"][s.start : s.end] for s in r[f"{side}_mask"]] == [t.text + "<|end|>" for t in (other or [])[r.prefix_turns :] if t.role == "assistant"]


def test_conversations_tables(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 2, "assistant", None), (None, 0, "user", "x"), (2, None, None, None), (3, 0, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = chat.conversations(turns)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in convs.collect()}
    assert got == {1: [("user", "a"), ("assistant", "b"), ("assistant", "")], 2: [("", "")], 3: [("user", "q")]}
    pairs = {r.conv_id: ([t.text for t in r.chosen], [t.text for t in r.rejected], r.usable) for r in chat.contrast_pairs(convs).collect()}
    assert pairs == {1: (["a", "b", ""], ["a", "b", ""], False), 2: ([""], [""], False), 3: (["q"], ["q"], False)}
    assert chat.preference_pairs(chat.contrast_pairs(chat.conversations(turns.where(F.lit(False))))).count() == 0


def test_contrast_pairs_take_another_conversations_answer(spark):
    rows = [(k, i, "assistant" if i % 2 else "user", f"{k if k % 3 else 'same'}-{i}") for k in range(60) for i in range(1 + k % 5)]
    convs = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    answers = {r.conv_id: [t.text for t in r.turns if t.role == "assistant"][-1:] for r in convs.collect()}
    got = chat.preference_pairs(chat.contrast_pairs(convs)).collect()
    assert len(got) == 60 and all(r.usable == bool(answers[r.conv_id]) for r in got)
    for r in got:
        if r.usable:
            at = max(i for i, t in enumerate(r.chosen) if t.role == "assistant")
            assert r.prefix_turns == at and [r.rejected[at].text] in answers.values() and r.rejected[at].text != r.chosen[at].text and r.chosen_mask and r.rejected_mask


def test_long_conversations_and_clashing_names(spark):
    n = 20_000
    turns = [{"role": "assistant" if k % 2 else "user", "text": f"t{k}"} for k in range(n)]
    docs = spark.createDataFrame([(1, turns, [*turns[:-1], {"role": "assistant", "text": "x"}], "p", "q"), (2, [], turns, "p", "q")], f"id long, chosen {chat.TURNS}, rejected {chat.TURNS}, prompt string, `odd.name` string")
    out = {r.id: r for r in chat.preference_pairs(docs).collect()}
    assert out[1].prefix_turns == n - 1 and out[1].chosen_text == f"<|assistant|>\nt{n - 1}<|end|>\n" and out[1].prompt.startswith("<|user|>") and out[1]["odd.name"] == "q"
    assert [out[2].rejected_text[s.start : s.end] for s in out[2].rejected_mask] == [f"{t['text']}<|end|>" for t in turns[1::2]]
