"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (n = 1..4, blended) present in both, over the root of the product of their own
numbers. Nyström landmarks, balanced over languages, turn it into features; one-versus-rest kernel ridge regression on them gives a score
for each language. Because the kernel is linear in presence vectors, landmark rows and ridge weights fold into one matrix (n-grams by
languages), and scoring is one matrix product for a batch of presence vectors.

Fitting uses a bounded sample: at most `sample_rows` labelled rows, equal shares for each language, only texts of at most `sample_chars` characters. A
language has one row at least; where there are more languages than `sample_rows`, the most frequent are learned. Prediction reads whole texts of all rows.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from .common import quoted, slices

NS, HASH_BITS, CHUNK = (1, 2, 3, 4), 22, 1 << 20
RANGE = 1 << 62


def has_letter(text: str) -> bool:
    """Number characters and marks are no letters."""
    return any(map(str.isalpha, text))


def ngrams(data: bytes) -> list[np.ndarray]:
    """For each n the codes of the n-grams of the bytes, in order: exact for n = 1 and 2, hashed to HASH_BITS bits beyond."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:] if len(b) > 2 else b[:0]
    four = three[:-1] << np.uint32(8) | b[3:] if len(b) > 3 else b[:0]
    fold = lambda x: (x * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)
    return [b, two, fold(three), fold(four)]


def pieces(text: str):
    """The text's bytes in pieces that share three bytes with the next, so that no n-gram is lost."""
    data = text.lower().encode("utf-8", "surrogatepass")
    for k in range(0, max(1, len(data)), CHUNK):
        yield data[k : k + CHUNK + max(NS) - 1]


def present(text: str) -> np.ndarray:
    """Sorted distinct n-gram codes; the n is in the high bits."""
    found = [np.unique(np.concatenate([c | np.uint32(k << 24) for k, c in enumerate(ngrams(p))])) for p in pieces(text)]
    return np.unique(np.concatenate(found))


class Model:
    """languages, and the codes and weights of the n-grams that count."""

    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray):
        self.languages, self.codes, self.weights = languages, codes, weights.astype(np.float32)

    def tables(self) -> list[np.ndarray]:
        """For each n: code -> place in weights plus one, or 0."""
        out = [np.zeros(size, np.uint16) for size in (1 << 8, 1 << 16, 1 << HASH_BITS, 1 << HASH_BITS)]
        for place, code in enumerate(self.codes.tolist(), 1):
            out[code >> 24][code & 0xFFFFFF] = place
        return out

    def scores(self, texts: list[str], tables: list[np.ndarray]) -> np.ndarray:
        has = np.zeros((len(texts), len(self.codes) + 1), np.float32)
        for row, text in zip(has, texts, strict=True):
            for data in pieces(text):
                for table, codes in zip(tables, ngrams(data), strict=True):
                    row[table[codes]] = 1
        has = has[:, 1:]
        return (has @ self.weights) / np.sqrt(np.maximum(has.sum(axis=1, keepdims=True), 1))


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int = 256, features: int = 16_000, ridge: float = 1e-2) -> Model:
    """From (language, n-gram codes) rows. n-grams in one row only are left out, and beyond `features` the rarer ones."""
    languages = sorted({lang for lang, _ in sample})
    codes, often = np.unique(np.concatenate([c for _, c in sample]), return_counts=True)
    order = np.lexsort((codes, -often))[:features]
    codes = np.sort(codes[order][often[order] > min(1, len(sample) - 1)])
    x = np.zeros((len(sample), len(codes)), np.float32)
    for row, (_, c) in zip(x, sample, strict=True):
        row[np.searchsorted(codes, np.intersect1d(c, codes, assume_unique=True))] = 1
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    by_lang = [[i for i, (lang, _) in enumerate(sample) if lang == name] for name in languages]
    turns = [i for k in range(max(map(len, by_lang))) for rows in by_lang for i in rows[k : k + 1]]
    marks = x[turns[:landmarks]]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * max(value.max(), 1e-6)
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = (x @ marks.T) @ root
    y = np.array([[1.0 if lang == name else -1.0 for name in languages] for lang, _ in sample])
    # Rows of a rare language weigh as much as those of a frequent one.
    weight = np.array([1 / len(by_lang[languages.index(lang)]) for lang, _ in sample])[:, None] * len(sample) / len(languages)
    solved = np.linalg.solve(phi.T @ (weight * phi) + ridge * len(sample) / landmarks * np.eye(phi.shape[1]), phi.T @ (weight * y))
    return Model(languages, codes, marks.T @ (root @ solved))


def train(rows: DataFrame, text: Column, lang: Column, spread: Column, sample_rows: int = 2000, sample_chars: int = 50_000) -> Model | None:
    """Fits on a sample of rows; spread is a column that tells rows apart, whose hash picks them. None without labelled rows.

    Rows that repeat text and spread count once. The order and partitions of rows don't matter.
    """
    rows = rows.select(text.cast("string").alias("t"), lang.cast("string").alias("l"), spread.alias("s")).where(f"l is not null and t is not null and length(t) between 1 and {sample_chars}")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(sample_rows).collect()}
    if not counts:
        return None
    share = sample_rows // len(counts)
    # Hashes below the limit are about twice a share, whatever the language's size; the least `share` of them are taken.
    limit = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(RANGE, (2 * share + 20) * RANGE // n))])
    hashed = rows.withColumn("h", F.pmod(F.xxhash64("s", "t"), F.lit(RANGE)))
    near = hashed.where(F.col("h") < F.coalesce(F.try_element_at(limit, F.col("l")), F.lit(0))).groupBy("l", "h").agg(F.min("t").alias("t"))
    picked = near.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= share).select("t", "l")

    def codes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([present(t).tobytes() for t in batch.column(0).to_pylist()], pa.binary())], ["l", "c"])

    found = sorted((r["l"], bytes(r["c"])) for r in picked.mapInArrow(codes, "l string, c binary").collect())
    return fit([(lang, np.frombuffer(c, np.uint32)) for lang, c in found]) if found else None


def predict(docs: DataFrame, model: Model | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """carry, lang_pred, score. `und` with score 0 for null texts and texts without a letter; score is a softmax of the languages' scores. Of languages with
    equal scores the first in alphabetical order counts.

    One row out for each row in, whole texts however long, in pieces of a million bytes. carry may be any columns but lang_pred and score.
    """
    if {"lang_pred", "score"} & set(carry):
        raise ValueError("lang_pred and score are names of results")
    rows = docs.select(*quoted(carry), F.col(f"`{text_col}`").cast("string").alias("__text"))
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model and (model.languages, model.codes, model.weights))

    def run(batches):
        held = sys.__dict__.setdefault("_corpusmill_languages", {})
        if key not in held:
            held.clear()
            model = Model(*sent.value) if sent.value else None
            held[key] = model, model and model.tables()
        model, tables = held[key]
        for batch in (b for whole in batches for b in slices(whole, 128)):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            known = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                s = model.scores([texts[i] for i in known], tables).astype(np.float64)
                e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                for i, k, p in zip(known, s.argmax(axis=1), (e / e.sum(axis=1, keepdims=True)).max(axis=1), strict=True):
                    lang[i], score[i] = model.languages[k], p
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [f"c{k}" for k in range(len(carry) + 2)])

    kinds = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    plain = rows.toDF(*[f"c{k}" for k in range(len(kinds) - 1)])
    made = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(kinds)])
    return plain.mapInArrow(run, made).toDF(*kinds.names)
