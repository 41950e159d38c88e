import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import decontam, langid, licenses, pii
from corpusmill.llm.queries import op2_language_id, op6_license_scan, op7_pii, op10_decontamination

from .helpers import PROSE, awkward, empty

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in twice) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = {"ip": kind == "ip" and any(int(x) > 255 for x in m[0].split(".")), "card": kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)), "phone": not 9 <= len(digits) <= 15}
            if not bad.get(kind):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TRICKY = [
    "a@b.cc@d.ee a@b.c-d.e%x@f.g.h", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255 1.2.3", "4111 1111 1111 1111-4111111111111111 +1 (555) 123-4567 +49--12345678 4111-1111-1111-1111",
    "", None, "é@é x@y.z @@a@b.c..d", "😀 4111111111111111 a@b.co ", "+1 23 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9", "a" * 50_000 + "@" + "b" * 20_000, "1" * 50_000 + ".1.1", "x@y.c " * 2000, "+1 555 010 9999\n4111111111111111",
]


def test_base_spans_equal_plain_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r.doc_id: r.b for r in pii.find_spans(docs, ["doc_id"]).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()}
    assert got == {k: brute_spans(t) for k, t in enumerate(TRICKY)}


def test_op7_contract(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x.startswith(k) for x in want.split(",")) for k in KINDS]
        assert r.spans.startswith(want)


def test_weak_supervision_learns_who_is_right():
    good = {"kind": "secret", "gazetteer": -1, "size": 5, "quoted": 1}
    bad = good | {"quoted": 0, "size": 4}
    patterns = [good | {"regex": 1, "context": 1, "shape": 1, "count": 90}, good | {"regex": 1, "context": -1, "shape": 1, "count": 40}, bad | {"regex": 0, "context": 0, "shape": 0, "count": 150}, bad | {"regex": 0, "context": -1, "shape": 1, "count": 30}]
    model = pii.fit(patterns)
    assert model["posterior"][0] > 0.95 and model["posterior"][1] > 0.9 and model["posterior"][2] < 0.05
    assert min(model["says"][j, y] for j in ("regex", "context", "shape") for y in (0, 1)) > 0.85
    score = lambda p: sum(model["weights"].get((k, p[k]), 0) for k in ("kind", *pii.FEATURES))
    assert score(patterns[0]) > 0 > score(patterns[2])


def test_added_spans_and_redaction(spark):
    secret = "token = \"f4fddc3c96e5e269ce7e65dcd469a6a9ed407e8e\""
    rows = [(k, f"{PROSE} {secret} mail a@b.co end") for k in range(20)] + [(30 + k, f"{PROSE} the well-known-and-long-word-2nd here") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_spans(docs, ["doc_id"]).collect()}
    assert [s.kind for s in found[0]] == ["email", "secret"] and not found[30]
    joined = docs.join(pii.find_spans(docs, ["doc_id"]), "doc_id").where("doc_id = 0").select(pii.redact(F.col("text"), F.col("spans")).alias("t")).first().t
    assert joined == f'{PROSE} token = "<SECRET>" mail <EMAIL> end'


def planted_pii(n=1500, seed=21):
    """(texts, personal spans, decoys): sets of (doc, kind, start, end) of secrets, numbers and names, and of look-alikes."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    low, up, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    mixed = lambda k: pick(low, 2) + pick(up, 2) + pick(digit, 3) + pick(low + up + digit, k - 7)
    names = ["Smith", "Müller", "García", "Dupont", "Johnson", "Schmidt", "Lefèvre", "Okafor", "Tanaka"]
    good = {
        "secret": [
            lambda: ('api_key = "', mixed(32), '"'), lambda: ("token: ghp_"[:7], "ghp_" + mixed(36), ""), lambda: ("password=", mixed(24), ";"), lambda: ('token = "', pick(hexa, 40), '"'),
            lambda: ("key id ", "AKIA" + pick(up + digit, 14) + "7A", ""), lambda: ("Authorization: Bearer ", mixed(260), ""), lambda: ("secret: ", "sk-" + mixed(45), ""),
        ],
        "number": [
            lambda: ("SSN ", f"{pick(digit, 3)}-{pick(digit, 2)}-{pick(digit, 4)}", ""), lambda: ("call ", f"(555) {pick('23456789', 1)}{pick(digit, 2)}-{pick(digit, 4)}", " today"),
            lambda: ("tel. ", f"0{pick('123456789', 1)} {pick(digit, 2)} {pick(digit, 2)} {pick(digit, 2)} {pick(digit, 2)}", ""), lambda: ("phone: ", f"{pick('23456789', 1)}{pick(digit, 2)}-555-{pick(digit, 4)}", ""),
        ],
        "name": [lambda: ("dear ", f"{rng.choice(['Mr.', 'Mrs', 'Dr.', 'Herr', 'Frau', 'Mme', 'Sr.'])} {rng.choice(names)}", ","), lambda: ("signed ", f"{rng.choice(['Dr.', 'Prof.', 'Ms.'])} {rng.choice(names)}", "")],
    }
    bad = {
        "secret": [
            lambda: ("commit ", pick(hexa, 40), ""), lambda: ("sha256: ", pick(hexa, 64), ""), lambda: ("md5 checksum ", pick(hexa, 32), ""), lambda: ("see ", f"{pick(low, 6)}-{pick(low, 7)}-{pick(low, 5)}-2nd-part", ""),
            lambda: ("call ", f"compute_{pick(low, 8)}_values_v2_{pick(low, 4)}", "()"), lambda: ("at http://x.org/", f"{pick(low, 7)}-{pick(low, 9)}-20", "/"),
        ],
        "number": [lambda: ("on ", f"20{pick('01', 1)}{pick(digit, 1)}-0{pick('123456789', 1)}-1{pick(digit, 1)}", ""), lambda: ("population = ", f"{pick('123456789', 1)} {pick(digit, 3)} {pick(digit, 3)}", ""), lambda: ("page ", f"1{pick(digit, 6)}", ""), lambda: ("costs $ ", f"{pick('123456789', 4)}{pick(digit, 4)}", "")],
        "name": [lambda: ("so ", f"Mr {rng.choice(['President', 'The', 'And'])}", ""), lambda: ("old ", f"Dr {rng.choice(['Who', 'Will'])}", "")],
    }
    texts, marks = [], ([], [])
    for doc in range(n):
        text = PROSE[: rng.randint(10, 200)] + " "
        for _ in range(rng.randint(1, 4)):
            wanted, kind = rng.random() < 0.5, rng.choice(pii.ADDED)
            before, body, after = rng.choice((good if wanted else bad)[kind])()
            text += before
            marks[0 if wanted else 1].append((doc, kind, len(text), len(text) + len(body)))
            text += f"{body}{after} {PROSE[: rng.randint(5, 90)]}. "
        texts.append((doc, text))
    return texts, set(marks[0]), set(marks[1])


def test_recall_and_precision_of_planted_spans(spark):
    texts, good, bad = planted_pii()
    rows = pii.find_spans(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"]).collect()
    found = {(r.doc_id, s.kind, s.start, s.end) for r in rows for s in r.spans if s.kind in pii.ADDED}
    for kind in pii.ADDED:
        of = lambda xs: {x for x in xs if x[1] == kind}  # noqa: B023, E731
        recall, precision = len(of(found & good)) / len(of(good)), len(of(found & good)) / max(1, len(of(found)))
        print(kind, len(of(good)), len(of(bad)), round(recall, 3), round(precision, 3))
        assert recall >= 0.9 and precision >= 0.9, (kind, recall, precision, sorted(of(good - found))[:5], [texts[x[0]][1][x[2] - 15 : x[3]] for x in sorted(of(found - good))[:5]])


def test_texts_of_many_matches_take_linear_time(spark):
    n = 100_000
    text = "".join(f'token = "a{k:06d}bcdefXghij0123456789" u{k}@x.org ' for k in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.find_spans(docs, ["doc_id"]).first().spans
    ends = [m.end() for m in re.finditer("[0-9]@x.org", text)]
    assert len(spans) == 2 * n and [s.end for s in spans[:n]] == ends and text[spans[n].start : spans[n].end] == "a000000bcdefXghij0123456789"


def test_pii_awkward(spark):
    docs = awkward(spark)
    out = pii.find_spans(docs, ["doc_id", "quality", "odd.name"])
    assert out.count() == docs.count() and out.columns == ["doc_id", "quality", "odd.name", "base", "spans"]
    assert pii.find_spans(empty(spark), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        pii.find_spans(docs.withColumn("base", F.lit(1)), ["base"])


def best_distance(item, text):
    """Least edit distance of item to any part of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return min(row)


def test_myers_equals_table():
    rng = random.Random(2)
    for _ in range(200):
        item, text = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, n))) for n in (70, 90))
        masks = {}
        for k, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << k
        assert decontam.distance(item, masks, text) == best_distance(item, text)


def edit(rng, text, n):
    """n random edits."""
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        chars[at : at + 1] = rng.choice([[], [rng.choice("qxz")], [chars[at], rng.choice("qxz")]])
    return "".join(chars)


def all_distances(items, text):
    """Least edit distance of each item to any part of the whole text, without pieces or windows. test_myers_equals_table holds distance() against the plain table."""
    out = []
    for item in items:
        masks = {}
        for k, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << k
        out.append(decontam.distance(item, masks, text))
    return np.array(out)


def test_leaks_within_the_budget_are_found_and_no_others(spark):
    rng = random.Random(4)
    items = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(8, 25)))) for k in range(8)]
    docs, want = [], set()
    for n in range(96):
        body = edit(rng, items[n % 8][1], rng.randint(0, 20))
        docs.append((n, f"{PROSE[: 30 * (n % 3)]}\n{body.upper() if n % 2 else body}  {PROSE[:40]}"))
        for i, item in items:
            d = best_distance(decontam.normal(item), decontam.normal(docs[-1][1]))
            if d <= len(decontam.normal(item)) * 10 // 100:
                want.add((n, i, d))
    frame, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontam.find_leaks(frame, table).collect()}
    assert got == want and 20 < len({x[0] for x in want}) < 90
    left = {r.doc_id for r in decontam.drop_leaks(frame, table).collect()}
    assert left == {n for n, _ in docs} - {x[0] for x in want}


def test_op10_equals_distances_to_whole_texts(spark, sf):
    """All documents and all items of the table."""
    texts = {r.doc_id: decontam.normal(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: decontam.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for doc, text in texts.items():
        for (i, item), d in zip(items.items(), all_distances(list(items.values()), text), strict=True):
            if d <= len(item) * 10 // 100:
                want.add((doc, i, int(d)))
    assert {tuple(r) for r in op10_decontamination(spark, sf).collect()} == want and want


def recall(shares, seed=6, copies=12):
    """Share of items found by edit share of their length (5: exactly 5 %), among random English-like items."""
    rng = random.Random(seed)
    words = PROSE.split()
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(16, 70)))) for k in range(20)]
    match, out = decontam.Matcher(items, decontam.PERCENT, decontam.MIN_CHARS), {}
    for share in shares:
        hits = 0
        for k, item in items * copies:
            body = edit(rng, item, len(item) * share // 100)
            hits += any(i == k for i, _ in match.leaks(f"{PROSE} {body} {PROSE}"))
        out[share] = hits / len(items) / copies
    return out


def test_recall_by_edit_share():
    found = recall((0, 5, 8, 10))
    assert set(found.values()) == {1.0}


def test_pieces_cover_the_item():
    for m in range(40, 400):
        k = m // 10
        parts = decontam.pieces_of(m, k)
        assert len(parts) == k + 1 and parts[0][0] == 0 and parts[-1][1] == m and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        assert all(b > a and (p == q or p == b or q == a) for a, b, p, q in parts) and sum(p == q for *_, p, q in parts) == (k + 1) % 2


def test_short_items_stand_exactly(spark):
    items = spark.createDataFrame([(1, "Who wrote  the red book of Hergest?"), (2, "yes"), (3, "capital of France is")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x who WROTE the\nred book of hergest? y"), (2, "who wrote the red book of hergest"), (3, "Yes\nno"), (4, "oh yes it is"), (5, "the capital of france is x"), (6, "capital of France isn"), (7, None), (8, " YES ")], "doc_id long, text string")
    want = {(1, 1, 0), (3, 2, 0), (5, 3, 0), (8, 2, 0)}
    assert {tuple(r) for r in decontam.find_leaks(docs, items).collect()} == want
    assert {r.doc_id for r in decontam.drop_leaks(docs, items).collect()} == {2, 4, 6, 7}


def test_item_blocks_give_the_same(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "benchmark"))
    whole = sorted(map(tuple, op10_decontamination(spark, sf).collect()))
    left = sorted(r.doc_id for r in decontam.drop_leaks(docs, items).collect())
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 3000)
    assert sorted(map(tuple, op10_decontamination(spark, sf).collect())) == whole and whole
    assert sorted(r.doc_id for r in decontam.drop_leaks(docs, items).collect()) == left


def test_decontamination_awkward(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, PROSE), (4, PROSE), (None, PROSE)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()} == {(d, i) for d in (1, 5, 7, None) for i in (4, None)}
    left = decontam.drop_leaks(docs, items)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "4", "6", "None"]
    assert decontam.find_leaks(empty(spark), items).count() == 0
    none = items.where("false")
    assert decontam.find_leaks(docs, none).count() == 0 and decontam.drop_leaks(docs, none).count() == docs.count()
    named = docs.withColumn("doc_id", F.concat(F.lit("a/"), F.col("doc_id").cast("string")))
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(named, items.withColumn("item_id", F.lit("i")), id_col="doc_id").collect()} == {(d, "i") for d in ("a/1", "a/5", "a/7", None)}
    with pytest.raises(ValueError):
        decontam.find_leaks(docs, items, id_col="item_id")


def test_language_accuracy_on_held_out_rows(spark, sf):
    rows = op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_awkward(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    rows = awkward(spark).select("doc_id", "text", F.col("quality").alias("odd.name"))
    odd = spark.createDataFrame([(90, "123 !!"), (93, "½ ² Ⅷ ①② ٣ ़"), (91, "é"), (92, "x" * 3_000_000)], "doc_id long, text string").withColumn("odd.name", F.lit("q"))
    got = langid.predict(rows.union(odd), model, ["doc_id", "odd.name"]).collect()
    assert len(got) == 14
    with pytest.raises(ValueError):
        langid.predict(rows, model, ["doc_id", "score"])
    for r in got:
        if r.doc_id in (2, 3, 4, 90, 93):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id in (1, 91, 92):
            assert r.lang_pred in ("de", "en", "es", "fr")
    assert langid.train(empty(spark), F.col("text"), F.col("lang"), F.col("doc_id")) is None
    assert {r.lang_pred for r in langid.predict(rows, None, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(empty(spark), model, ["doc_id"]).count() == 0


def test_folded_scores_equal_the_kernel(spark, sf):
    """Scores by explicit kernel values, Nyström features and ridge weights."""
    rows = [(r.lang, r.text[:3000]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").limit(90).collect()]
    sample, n, ridge = [(lang, langid.present(t)) for lang, t in rows], 24, 1e-2
    model = langid.fit(sample, landmarks=n, features=1 << 30, ridge=ridge)
    known = set(model.codes.tolist())
    sets = [set(c.tolist()) & known for _, c in sample]
    langs = [lang for lang, _ in sample]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    turns = sorted(range(len(rows)), key=lambda i: (langs[:i].count(langs[i]), langs[i]))[:n]
    k_mm = np.array([[kernel(sets[i], sets[j]) for j in turns] for i in turns])
    k_xm = np.array([[kernel(s, sets[j]) for j in turns] for s in sets])
    value, vector = np.linalg.eigh(k_mm)
    assert value.min() > 1e-6 * value.max()
    phi = k_xm @ vector / np.sqrt(value)
    y = np.array([[1.0 if x == name else -1.0 for name in model.languages] for x in langs])
    w = np.array([len(rows) / len(model.languages) / langs.count(x) for x in langs])[:, None]
    solved = np.linalg.solve(phi.T @ (w * phi) + ridge * len(rows) / n * np.eye(n), phi.T @ (w * y))
    got = model.scores([t for _, t in rows], model.tables())
    assert model.languages == sorted(set(langs)) and np.abs(got - phi @ solved).max() < 1e-5


def test_language_sample_is_bounded_and_order_free(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    fit, langid.fit = langid.fit, lambda sample, **options: seen.append(sample) or fit(sample, **options)
    try:
        args = F.col("text"), F.col("lang"), F.col("doc_id")
        a, b = langid.train(docs, *args, sample_rows=40), langid.train(docs.union(docs).orderBy(F.desc("text")).repartition(7), *args, sample_rows=40)
        many = docs.withColumn("lang", F.concat("lang", F.lit("-"), F.col("doc_id").cast("string")))
        c = langid.train(many, *args, sample_rows=40)
    finally:
        langid.fit = fit
    assert [len(x) for x in seen] == [40, 40, 40] and {x: [lang for lang, _ in seen[0]].count(x) for x in a.languages} == dict.fromkeys(a.languages, 10)
    assert (a.codes == b.codes).all() and np.abs(a.weights - b.weights).max() < 1e-5 and len(c.languages) == 40


def test_kernel_pieces_lose_no_ngram(monkeypatch):
    text = PROSE + " é ü 😀 " + PROSE[::-1]
    whole = langid.present(text)
    monkeypatch.setattr(langid, "CHUNK", 17)
    assert langid.present(text).tolist() == whole.tolist()


def test_license_texts_are_found_where_they_are(spark):
    mit, gpl = licenses.TEMPLATES["MIT"][1], licenses.TEMPLATES["GPL-3.0"][0]
    changed = mit.replace("publish", "print")
    rows = [(1, f"{PROSE} {mit}\n{PROSE}"), (2, f"{PROSE} {gpl.upper()} {PROSE}"), (3, PROSE), (4, f"é {changed}"), (5, " ".join(mit.split()[:12])), (6, f"{gpl} {PROSE} Released under the MIT License."), (7, None), (8, "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.licenses for k, r in got.items()} == {1: "MIT", 2: "GPL-3.0", 3: "", 4: "MIT", 5: "", 6: "GPL-3.0,MIT", 7: "", 8: ""}
    m = got[1].matches[0]
    assert rows[0][1][m.start : m.end] == mit.rstrip() or mit.startswith(rows[0][1][m.start : m.end])
    assert m.percent == 100 and got[4].matches[0].percent < 100


def test_license_bands_guarantee():
    assert licenses.collision_probability(0.25) > 0.999999
    scanner = licenses.Scanner([("L", PROSE)], 80, licenses.BANDS)
    (size,) = scanner.classes
    assert 2 * len(scanner.sets[0][1]) <= size <= 4 * len(scanner.sets[0][1])
    filler = " ".join(f"f{k}" for k in range(500))
    assert all(scanner.scan([f"{' '.join(filler.split()[:k])} {PROSE} {filler}" for k in range(0, 130, 7)]))


def test_license_op_and_awkward(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    notice = {"GPL-3.0": "GNU General Public License, version 3", "MIT": "Released under the MIT License", "Apache-2.0": "Licensed under the Apache License, Version 2.0", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0"}
    for r in op6_license_scan(spark, sf).collect():
        assert set(r.licenses.split(",")) - {""} == {k for k, v in notice.items() if v in texts[r.doc_id]}
    assert licenses.scan(awkward(spark)).count() == awkward(spark).count() and licenses.scan(empty(spark)).count() == 0


def all_templates():
    return sorted((name, t) for name, texts in (licenses.TEMPLATES | licenses.NOTICES).items() for t in texts)


def test_planted_templates_are_the_matches_and_no_others(monkeypatch):
    """Names, offsets and counts, in texts of one and of many segments."""
    rng, scanner = random.Random(12), licenses.Scanner(all_templates(), licenses.PERCENT, licenses.BANDS)
    filler = lambda n: " ".join(rng.choice(PROSE.split()) + rng.choice(["", "", ",", "."]) for _ in range(n))
    texts, want = [], []
    for _ in range(60):
        text, spots = filler(rng.randint(0, 60)), []
        for _ in range(rng.randint(0, 7)):
            name, body = rng.choice(all_templates())
            first, *_, last = [m.span() for m in licenses.WORD.finditer(body)] * 2
            spots.append((name, len(text) + 1 + first[0], len(text) + 1 + last[1], 100))
            text += f" {body} x {filler(rng.choice([0, 3, 40, 300]))}"
        texts.append(text)
        want.append(spots)
    for segment in (licenses.SEGMENT, 64):
        monkeypatch.setattr(licenses, "SEGMENT", segment)
        got = scanner.scan([*texts, ""])
        assert [[m[1:] for m in x] for x in got] == [[m[1:] for m in x] for x in [*want, []]]
    # A text that two licenses share goes by the first name.
    same = {t: [n for n, x in all_templates() if licenses.word_hashes(x).tolist() == licenses.word_hashes(t).tolist()] for _, t in all_templates()}
    assert all(g[0] == w[0] or any({g[0], w[0]} <= set(x) for x in same.values()) for x, y in zip(got, want, strict=False) for g, w in zip(x, y, strict=True))


def test_edited_templates_are_found_as_exact_containment_says():
    """No band loses a template at the limit, alone in a long text."""
    rng = random.Random(13)
    named = [(str(k), t) for k, (_, t) in enumerate(all_templates()) if len(licenses.WORD.findall(t)) > 20]
    scanner = licenses.Scanner(named, licenses.PERCENT, licenses.BANDS)
    texts, want = [], []
    for k in range(300):
        name, body = named[k % len(named)]
        words = [f"z{rng.random()}".replace(".", "") if rng.random() < rng.choice([0, 0.02, 0.04, 0.06]) else w for w in licenses.WORD.findall(body)]
        whole = set(licenses.shingles(licenses.word_hashes(body)).tolist())
        have = set(licenses.shingles(licenses.word_hashes(" ".join(words))).tolist())
        want.append(100 * len(whole & have) >= 80 * len(whole))
        texts.append(f"{' '.join(f'a{k}x{i}' for i in range(k % 97))} {' '.join(words)} {' '.join(f'b{i}' for i in range(k))}")
    got = [any(m[0] == named[k % len(named)][0] for m in x) or (bool(x) and want[k]) for k, x in enumerate(scanner.scan(texts))]
    assert got == want and 100 < sum(want) < 290


def test_many_matches_in_one_text():
    text = "Licensed under CC BY 4.0. all rights reserved " * 20_000
    found = licenses.Scanner(all_templates(), licenses.PERCENT, licenses.BANDS).scan([text])[0]
    assert len(found) == 40_000


def test_short_templates_are_found_in_long_texts(spark, sf):
    long = f"{PROSE}. ALL rights\nreserved, {PROSE}"
    (m,) = licenses.scan(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()[0].matches
    assert (m.license, long[m.start : m.end], m.percent) == ("All-rights-reserved", "ALL rights\nreserved", 100)
    made = {"One": ["zork"], "Two": ["more zork here", "see number no way"], "Long": [f"zork {PROSE}"]}
    rows = [(1, "zork"), (2, f"more zork here, zork {PROSE}"), (3, "a more zork here b"), (4, "zorks more here"), (5, f"see number zork no way {PROSE}")]
    got = {r.doc_id: r.matches for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), made).collect()}
    assert [m.license for m in got[1]] == ["One"] and [m.license for m in got[3]] == ["Two"] and got[4] == []
    assert [m.license for m in got[2]] == ["Two", "Long"]
    assert [m.license for m in got[5]] == ["One", "Long"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    noticed = {r.doc_id for r in op6_license_scan(spark, sf).collect() if "All-rights-reserved" in r.matches}
    assert noticed == {k for k, t in texts.items() if "All rights reserved." in (t or "")} and noticed


def test_repeated_license_texts_are_matches_of_their_own():
    mit, apache = licenses.TEMPLATES["MIT"][1], licenses.TEMPLATES["Apache-2.0"][0]
    scanner = licenses.Scanner(sorted((name, t) for name, texts in licenses.TEMPLATES.items() for t in texts), licenses.PERCENT, licenses.BANDS)
    found = lambda text: [(name, text[a:b], score) for name, a, b, score in scanner.scan([text])[0]]
    whole, notice = ("MIT", mit.rstrip(), 100), ("Apache-2.0", apache.rstrip("."), 100)
    assert whole[1] == mit
    for k in range(0, 130, 13):
        before = " ".join(f"f{i}" for i in range(k))
        for gap in ("", " in between", " " + " ".join(PROSE.split()[:25])):
            assert found(f"{before} {mit}{gap} {apache} {mit} {before}") == [whole, notice, whole]
            assert found(f"{before} {mit}{gap} {mit} {mit} {before}") == [whole] * 3
    # Edits at the head of one copy and the tail of the next.
    words = mit.split()
    pair = f"{' '.join(['x', *words[3:]])} {' '.join([*words[:-3], 'y'])}"
    assert [name for name, *_ in found(pair)] == ["MIT", "MIT"]
    # Half a copy before a whole one is no match.
    assert found(" ".join(words[:25]) + " and " + mit) == [whole]
