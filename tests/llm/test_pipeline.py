"""run() and each stage of the corpus pipeline against plain Python, on the driver's smallest table with awkward rows added."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm import decontam, quality
from corpusmill.llm.queries import tokenizer_path

from .helpers import PROSE, components
from .test_neardup import sets_of
from .test_rules_lines_chat import brute as measures
from .test_text_operators import all_distances

STOP = set(quality.STOP_WORDS)


def keeps(text):
    text = text or ""
    n_words, word_chars, n_symbols, n_dup, n_repeat = measures(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "n_lines": len(lines), "1": 1}
    at["n_exclamations"], at["n_stop_words"] = text.count("!"), sum(re.sub(r"[.,;:!?]+$", "", w.lower()) in STOP for w in words)
    beyond = lambda r: 100 * at[r.measure] < r.percent * at[r.of] if r.side == "<" else 100 * at[r.measure] > r.percent * at[r.of]
    return not any(map(beyond, (*quality.BASE_RULES, *quality.RULES)))


def without_boilerplate(rows, percent=8, least=5):
    worded = lambda line: re.search(r"[^\x20\x09-\x0D]", line)
    total, pages = Counter(r["source"] for r in rows), Counter()
    for r in rows:
        for line in {x for x in (r["text"] or "").split("\n") if worded(x)}:
            pages[r["source"], line] += 1
    bad = {(s, x) for (s, x), n in pages.items() if s is not None and n >= least and 100 * n > percent * total[s]}
    out = []
    for r in rows:
        text = r["text"] if r["source"] is None else "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad)
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def without_copies(rows):
    sets = defaultdict(set)
    for r in rows:
        if r["doc_id"] is not None:
            sets[r["doc_id"]] |= sets_of([(0, r["text"])], 5)[0]
    label = components(sets)
    kept = [r for r in rows if r["doc_id"] is None or label[r["doc_id"]] == r["doc_id"]]
    least = {}
    for r in kept:
        key = (r["doc_id"], r["text"])
        if r["doc_id"] is not None and (key not in least or told(r) < told(least[key])):
            least[key] = r
    return [r for r in kept if r["doc_id"] is None] + list(least.values())


def told(row):
    return tuple((v is not None, v) for v in row.values())


def without_leaks(rows, items):
    items = [decontam.normal(t) for t in items]
    return [r for r in rows if (all_distances(items, decontam.normal(r["text"])) > np.array([len(x) * 10 // 100 for x in items])).all()]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The driver's documents (every fourth) and rows with nulls, repeats, hot lines, near copies, clashing ids, leaks, and a very long text."""
    rng, words = random.Random(9), PROSE.split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 4 = 0").collect()]
    items = [r.asDict() for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(8).collect()]
    row = lambda i, text, source="odd", lang="en": {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": None}
    base = prose(120)
    docs += [row(9000 + k, f"Home | About\n{prose(90)}\nAll pages end so") for k in range(12)]
    docs += [row(9100, base), row(9101, base + " tail"), row(9102, f"{base} other end"), row(9103, prose(150)), row(9103, prose(150)), row(9104, prose(100)), row(9104, None), row(9105, None), row(9106, ""), row(9107, " \n ")]
    docs += [row(9108, prose(110), None, None)] * 2 + [row(None, prose(100)), row(None, base), row(9109, base.upper()), row(9110, "word"), row(9111, prose(20_000))]
    docs += [row(9112, f"{prose(60)} {items[k]['text'][:-3].upper()} {prose(60)}") for k in (0,)] + [row(9113, docs[-1]["text"], lang="de"), row(9113, docs[-1]["text"], lang="aa")]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, [r["text"] for r in items]


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=told)


def test_run_and_each_stage_equal_plain_python(spark, folder, tmp_path):
    path, docs, items = folder
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "line_dedup", "minhash_neardup", "decontamination", "packing"]
    plain = {"quality_rules": lambda rows: [r for r in rows if keeps(r["text"])], "line_dedup": without_boilerplate, "minhash_neardup": without_copies, "decontamination": lambda rows: without_leaks(rows, items)}
    want, frame, sizes = docs, spark.read.parquet(f"{path}/documents.parquet"), [len(docs)]
    for name, step in plain.items():
        steps[name](spark, frame, path).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        want = sorted(step(want), key=told)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"] and rows_of(frame) == want, name
        sizes.append(len(want))
    assert sizes[0] > sizes[1] > sizes[3] > sizes[4] > 20
    ids = {r["doc_id"] for r in want}
    assert {9103, 9108, 9111, None} <= ids and not {9101, 9102, 9105, 9106, 9107, 9109, 9110, 9112} & ids and len([r for r in want if r["doc_id"] == 9103]) == 2
    assert not any(r["source"] == "odd" and "Home | About" in r["text"] for r in want)

    library, held = Tokenizer.from_file(tokenizer_path()), defaultdict(list)
    for r in corpus_pipeline.run(spark, path).collect():
        held[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        assert r.length == len(held[r.doc_id][-1][1]) <= 1024
    tokens = defaultdict(list)
    for r in want:
        tokens[r["doc_id"]].append([*library.encode(r["text"], add_special_tokens=False).ids, 0])
    assert set(held) == set(tokens)
    for doc, parts in tokens.items():
        if len(parts) == 1:
            assert [x for _, piece in sorted(held[doc]) for x in piece] == parts[0]
        else:
            assert Counter(x for _, piece in held[doc] for x in piece) == Counter(x for p in parts for x in p)


def test_empty_tables(spark, folder, tmp_path):
    path = folder[0]
    frame = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, path).count() == 0, name


def test_null_and_empty_texts_pass_later_stages(spark, folder):
    """Later stages see no such rows behind the first one, but stand on their own."""
    path = folder[0]
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (None, None, None, None, None), (2, "", "en", "a", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    count = {name: stage(spark, frame, path).count() for name, stage in corpus_pipeline.STAGES}
    assert count == {"quality_rules": 0, "line_dedup": 4, "minhash_neardup": 3, "decontamination": 4, "packing": 4}
