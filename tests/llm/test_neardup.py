import random

import numpy as np
import pytest

from corpusmill.llm import neardup
from corpusmill.llm.queries import op9_minhash_neardup

from .helpers import awkward, components, empty


def sets_of(rows, width):
    out = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        n = min(width, len(words))
        out[doc] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    return out


def test_op9_contract(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sets = sets_of(rows, 2)
    want = components(sets)
    for r in op9_minhash_neardup(spark, sf).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def edited(rng, words, share):
    return " ".join(f"x{rng.random()}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("small,block,shingles", [(32, 128, 1 << 20), (2, 3, 1 << 20), (2, 128, 900)])
def test_large_groups_lose_no_link(spark, monkeypatch, small, block, shingles):
    """A group whose members differ by 0 to 15 % of their words: many links that no star sees."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    rows = [(k, edited(rng, base, rng.choice([0.0, 0.02, 0.04, 0.05, 0.08]))) for k in range(120)]
    rows += [(1000 + k, " ".join(f"c{rng.random()}" for _ in range(60))) for k in range(20)] + [(2000 + k, rows[3][1].upper()) for k in range(40)]
    rng.shuffle(rows)
    want = components(sets_of(rows, 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, width=2).collect()}
    assert got == want and len(set(want.values())) > 25


def test_string_ids(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    rng = random.Random(3)
    base = [f"b{k}" for k in range(100)]
    rows = [(f"file/{k:03d}", edited(rng, base, rng.choice([0.0, 0.03, 0.05]))) for k in range(60)] + [("z", ""), (None, "a b c")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), width=2).collect()}
    want = components(sets_of(rows[:-1], 2))
    assert {k: v for k, v in got.items() if k} == want and got[None] is None


def test_chain_of_links_is_one_component(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(50 - k, " ".join(words[k * 5 : k * 5 + 100])) for k in range(50)]
    got = {r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == {min(r[0] for r in rows)}


def test_exact_threshold(spark):
    a = [f"w{k}" for k in range(10)]  # 9 pairs; 8 common of 10 is the threshold exactly
    rows = [(1, " ".join(a)), (2, " ".join([*a[:9], "z"])), (3, " ".join(["y", "x", *a[2:9], "z"]))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == components(sets_of(rows, 2)) == {1: 1, 2: 1, 3: 3}


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        elif r.doc_id in (2, 3, 4):
            assert (r.n_shingles, r.component_id, r.kept) == (0, r.doc_id, True)
    assert {r.component_id for r in got if r.doc_id in (1, 7)} == {1}
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_signature_is_circulant_and_estimates_jaccard():
    sign = neardup._signer(32, 4)
    rng = np.random.RandomState(0)
    a = rng.randint(0, 2**63, 600).astype(np.uint64) * np.uint64(2)
    for share in (0.3, 0.6, 0.9):
        b = np.concatenate([a[: int(600 * share)], rng.randint(0, 2**63, 600 - int(600 * share)).astype(np.uint64) * np.uint64(2)])
        truth = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((sign(a) == sign(b)).mean() - truth) < 0.15
    one = np.array([5 << (64 - neardup.UNIVERSE_BITS)], np.uint64)
    two = np.array([6 << (64 - neardup.UNIVERSE_BITS)], np.uint64)
    assert (sign(one)[1:] == sign(two)[:-1]).all()  # the next place sees the same table, shifted by one


def test_components_of_a_long_path(spark):
    from corpusmill.llm.common import Scratch

    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "x long, y long")
    got = {r.node: r.label for r in neardup.components(edges, Scratch(spark, "test")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
