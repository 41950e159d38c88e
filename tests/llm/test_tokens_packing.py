import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import packing, tokenfiles, tokens
from corpusmill.llm.queries import op3_token_files, op4_packing, tokenizer_path
from corpusmill.llm.tokens import Encoder

from .helpers import awkward, empty


@pytest.fixture(scope="module")
def encode():
    return Encoder(tokenizer_path())


def plain(encode, texts):
    return [x.ids for x in encode.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_cached_encoding_equals_plain(encode, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    random.seed(5)
    parts = [*"ab é1.,!'\n\t x\r\x85\x1c\x01", "  ", "don't ", "<|endoftext|>", "😀", "日本 ", " ", "Word.\nNext", "e.g. ", "ǅ", "ª"]
    texts += ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(3000)] + [None, "", " ", "    ", "a" * 50_000]
    got = encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == plain(encode, texts)
    assert encode(pa.array([], pa.string())) == [] or len(encode(pa.array([], pa.string()))) == 1


def test_added_tokens_are_as_the_library_has_them(spark, encode, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = ["end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>.\nB <|endoftext|><|endoftext|> c  ", "<|endoftext|", "x <|endoftext |> y", "plain words, here."]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [437, 220, 50256, 1306]
    assert [x.tolist() for x in encode(pa.array(texts * 2))] == want * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenfiles.write_token_files(docs, str(tmp_path / "a"), tokenizer_path(), 2)
    back = sorted(tokenfiles.read_token_files(spark, str(tmp_path / "a")).collect())
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in back] == [[*x, 2] for x in want]
    assert [r.start for r in back] == np.cumsum([0, *[len(x) + 1 for x in want[:-1]]]).tolist()
    check_packed(packing.pack(docs, tokenizer_path(), 0).collect(), {i: np.array([*x, 0], "<u4") for i, x in enumerate(want)})


def test_texts_without_spaces_take_bounded_memory(monkeypatch):
    """Each such text is one word: the cache is bounded by bytes as well as by words, and what the library encodes at once."""
    monkeypatch.setattr(tokens, "CACHED_BYTES", 1 << 18, raising=False)
    own, r, given = Encoder(tokenizer_path()), random.Random(3), []

    class Library:
        def encode_batch_fast(self, texts, **options):
            given.append(sum(len(x.encode()) for x in texts))
            return own.tokenizer.encode_batch_fast(texts, **options)

    for _ in range(6):
        texts = ["".join(map(chr, r.choices(range(0x4E00, 0x9000), k=500))) for _ in range(100)]
        assert [x.tolist() for x in own(pa.array(texts))] == plain(own, texts)
        assert sum(len(w.encode()) + len(ids) for held in (own.words, getattr(own, "before", {})) for w, ids in held.items()) < 1 << 20  # the bound, and a batch for each half
    many = ["Spaceless" * 10_000, "", *["ab" * 20_000] * 30, "last"]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.plain(many, Library())] == plain(own, many)
    assert max(given) <= 1 << 20 and sum(given) == sum(map(len, many)) and own.plain([]) == []


@pytest.mark.parametrize("ids", [[], [7], [1] * 300, list(range(70_000)), [3, 3, 2, 2, 9]])
def test_block_code_round_trip(ids):
    a = np.array(ids, np.uint32)
    ranked, control, data = tokenfiles.compress(a)
    assert len(control) == -(-len(a) // 4)
    assert tokenfiles.expand(ranked, control, data, len(a)).tolist() == ids


def test_ranks_are_by_frequency():
    ranked, control, data = tokenfiles.compress(np.array([5, 9, 9, 9, 5, 4], np.uint32))
    assert np.frombuffer(ranked, "<u4").tolist() == [9, 5, 4] and list(data) == [1, 0, 0, 0, 1, 2] and control == b"\0\0"


def expected(encode, rows, end):
    return {i: np.array([*ids, end], "<u4") for i, ids in zip([r[0] for r in rows], plain(encode, [r[1] for r in rows]), strict=True)}


def test_op3_contract(spark, sf, encode):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, start = expected(encode, rows, 2), 0
    got = sorted(map(tuple, op3_token_files(spark, sf).collect()))
    assert len(got) == len(rows)
    for doc, s, n, crc in got:
        assert (s, n, crc) == (start, len(want[doc]), zlib.crc32(want[doc].tobytes()))
        start += n


def test_token_files_awkward(spark, tmp_path, encode):
    docs = awkward(spark)
    tokenfiles.write_token_files(docs, str(tmp_path / "a"), tokenizer_path(), 2)
    back = tokenfiles.read_token_files(spark, str(tmp_path / "a")).collect()
    ids = sorted((np.frombuffer(r.ids, "<u4").tolist() for r in back), key=str)
    assert ids == sorted(([*x, 2] for x in plain(encode, [r.text for r in docs.collect()])), key=str)
    spans = sorted((r.start, r.n_tokens) for r in back)
    assert [s for s, _ in spans] == np.cumsum([0, *[n for _, n in spans[:-1]]]).tolist()
    tokenfiles.write_token_files(empty(spark), str(tmp_path / "b"), tokenizer_path(), 2)
    assert tokenfiles.read_token_files(spark, str(tmp_path / "b")).count() == 0


def check_packed(rows, want, length=1024, copies=1):
    held, sequences = {}, {}
    for doc, start, size, ids, total, seq, offset in rows:
        ids = np.frombuffer(ids, "<u4")
        assert len(ids) == size
        held.setdefault(doc, []).append((start, ids, total))
        sequences.setdefault(seq, []).append((offset, size))
    for doc, ids in want.items():
        parts = sorted(held.pop(doc), key=lambda p: p[0])
        if copies == 1:
            assert np.concatenate([p[1] for p in parts]).tolist() == ids.tolist() and parts[0][0] == 0
        assert all(p[2] == len(ids) and ids[p[0] : p[0] + len(p[1])].tolist() == p[1].tolist() for p in parts)
    assert not held
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_op4_contract_and_padding(spark, sf, encode):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = expected(encode, rows, 0)
    got = packing.pack(spark.read.parquet(f"{sf}/documents.parquet").repartition(5), tokenizer_path(), 0).collect()
    padding = check_packed(got, want)
    assert padding <= 0.01 * sum(map(len, want.values()))
    query = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in op4_packing(spark, sf).collect()}
    assert all(zlib.crc32(want[d][s : s + n].tobytes()) == c for d, s, n, c in query)


def test_pack_awkward(spark, encode):
    docs = awkward(spark)
    got = packing.pack(docs, tokenizer_path(), 0).collect()
    rows = docs.collect()
    assert sum(r.length for r in got) == sum(len(x) + 1 for x in plain(encode, [r.text for r in rows]))
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack(empty(spark), tokenizer_path(), 0).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer_path(), 0, length=1000)


def test_string_ids(spark, encode, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "RANGE_BYTES", 100)
    rows = [(f"part/{k:03d}", " ".join(["some words"] * (k % 7 * 80))) for k in range(60)] + [(None, "x")]
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = expected(encode, rows, 0)
    check_packed(packing.pack(docs, tokenizer_path(), 0).collect(), want)
    assert tokenfiles.input_bytes(docs) > 500
    tokenfiles.write_token_files(docs, str(tmp_path / "s"), tokenizer_path(), 0)
    back = sorted(tokenfiles.read_token_files(spark, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == [None, *sorted(x for x, _ in rows if x)] and all(np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id].tolist() for r in back)
    assert [r.start for r in back] == np.cumsum([0, *[r.n_tokens for r in back[:-1]]]).tolist()


def test_windows_are_bounded_and_best_fit():
    w = packing.Windows(0, 8, 2, 0)
    add = lambda doc, n: w.add(doc, 0, np.full(n, doc, np.uint32), n)
    for doc, n in ((1, 5), (2, 6), (3, 2)):
        add(doc, n)
    assert [(r[0], r[6]) for r in w.rows] == [(2, 0), (3, 6)] and len(w.open) == 1  # 3 fits best beside 2
    add(4, 7)
    add(5, 4)  # fits nowhere: its head fills the fullest window
    assert len(w.open) <= 2 and [r[2] for r in w.rows if r[0] == 5][0] == 1
    w.flush()
    assert not w.open and sum(r[2] for r in w.rows) == 24
    sizes = {}
    for r in w.rows:
        sizes[r[5]] = sizes.get(r[5], 0) + r[2]
    assert all(s & (s - 1) == 0 for s in sizes.values())
