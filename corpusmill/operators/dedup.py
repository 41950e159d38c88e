"""Exact and MinHash deduplication. Of equal or similar documents the one with the least order key stays."""

from __future__ import annotations

from functools import cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import text as T
from .durable import keep

#: Words whose hashes a worker holds; texts of many different words make it forget them.
KNOWN = 100_000
PRIME, FACTOR = (1 << 61) - 1, 0x9E3779B97F4A7C15


def exact_firsts(docs: DataFrame, key: Column, order: str) -> DataFrame:
    """(key hash, first): the least order of each key. Only hashes are shuffled, summed where they are read."""
    h = F.sha2(key.cast("string"), 256)
    return docs.select(h.alias("__key"), F.col(order).alias("__at")).groupBy("__key").agg(F.min("__at").alias("first"), F.count("*").alias("copies"))


def exact_dedup(docs: DataFrame, key: Column | None = None, order: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(kept, removed): first documents of each key, and the others. Order keys must be unique. A null key is a key like others.

    Only (hash, order) pairs are grouped; the orders to remove come back in an anti-join on the unique order key, which no hot key skews."""
    key = F.col("text") if key is None else key
    rows = docs.select(F.coalesce(F.sha2(key.cast("string"), 256), F.lit("")).alias("__key"), F.col(order).alias("__at"))
    firsts = rows.groupBy("__key").agg(F.min("__at").alias("__at"))
    stays = firsts.select(F.col("__at").alias(order))
    return docs.join(stays, order, "left_semi"), docs.join(stays, order, "left_anti")


@cache
def constants(hashes: int, seed: int) -> tuple:
    """Multipliers and offsets of the permutations."""
    draw = np.random.RandomState(seed)
    return tuple(draw.randint(low, PRIME, size=hashes, dtype=np.uint64) for low in (1, 0))


def candidate_probability(similarity: float, buckets: int = 14, rows: int = 8) -> float:
    return 1 - (1 - similarity**rows) ** buckets


def similarity_threshold(buckets: int = 14, rows: int = 8) -> float:
    return buckets ** (-1 / rows)


def word_hash(word: str) -> int:
    """The first 64 bits of the word's MD5."""
    return int.from_bytes(md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:8], "big")


def powers(n: int) -> list[int]:
    """Factors of the hashes of a shingle's words, first word first."""
    return [pow(FACTOR, n - 1 - k, 1 << 64) for k in range(n)]


def signature_of(words: list[str], n: int, a: np.ndarray, b: np.ndarray, known: dict[str, int] | None = None) -> np.ndarray | None:
    """The least of (h * a + b mod 2**64) mod PRIME over n-word shingles, for each (a, b); None if there are fewer words. h is the sum of the words' hashes times powers of FACTOR,
    mod 2**64. `known` keeps hashes of words from text to text."""
    if len(words) < n:
        return None
    known = {} if known is None else known
    for w in set(words).difference(known):
        known[w] = word_hash(w)
    of_words = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = len(words) - n + 1
    out, low = np.full(len(a), PRIME, np.uint64), np.uint64(PRIME)
    with np.errstate(over="ignore"):
        h = np.unique(sum((of_words[k : k + size] * np.uint64(p) for k, p in enumerate(powers(n))), np.zeros(size, np.uint64)))
        held = np.empty((2, min(size, 128), len(a)), np.uint64)  # both fit in the processor's cache
        for k in range(0, len(h), 128):
            part = h[k : k + 128, None]
            x, high = held[:, : len(part)]
            np.add(np.multiply(part, a, out=x), b, out=x)
            np.right_shift(x, np.uint64(61), out=high)
            np.add(np.bitwise_and(x, low, out=x), high, out=x)  # the remainder of a Mersenne prime, but for one subtraction
            if x.max() >= low:
                np.subtract(x, low, out=x, where=x >= low)
            np.minimum(out, x.min(axis=0), out=out)
    return out


def signature(text: Column, n: int = 5, buckets: int = 14, rows: int = 8, seed: int = 1) -> Column:
    """array<bigint> of buckets * rows minima, or null for texts of fewer than n words. Texts are simplified on the JVM side."""
    a, b = constants(buckets * rows, seed)

    @F.arrow_udf("array<long>")
    def sign(texts: pa.Array) -> pa.Array:
        known: dict[str, int] = {}
        signed = np.zeros((len(texts), buckets * rows), np.int64)
        missing = np.ones(len(texts), bool)
        for k, t in enumerate(texts):
            if len(known) > KNOWN:
                known.clear()
            s = None if not t.is_valid else signature_of(t.as_py().split(), n, a, b, known)
            if s is not None:
                signed[k], missing[k] = s.astype(np.int64), False
        ends = np.concatenate([[0], np.cumsum(np.where(missing, 0, buckets * rows))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed[~missing].reshape(-1)), mask=pa.array(missing))

    return sign(T.simplify_text(text))


def estimated_similarity(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays read as sets; of two empty ones 1."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the least node reachable, from edges (x, y). Labels move to neighbours, then to labels of labels, until none moves; each round is a table in the shared folder."""
    both = keep(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    labels = keep(both.groupBy(F.col("x").alias("node")).agg(F.least("node", F.min("y")).alias("label")))
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        stepped = keep(labels.join(near, labels.node == near.x).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        up = stepped.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = keep(stepped.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("was")).alias("moved")))
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "label")


def star_edges(signed: DataFrame, order: str, signature_col: str, buckets: int = 14) -> DataFrame:
    """Edges (x, y) from each member of a bucket to its least member: as many as members, not pairs, and the same components as a chain."""
    rows = F.size(signature_col) / buckets
    bands = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.xxhash64(k, F.slice(signature_col, (k * rows + 1).cast("int"), rows.cast("int"))))
    exploded = keep(signed.where(F.col(signature_col).isNotNull()).select(F.col(order).alias("x"), F.explode(bands).alias("band")))
    least = keep(exploded.groupBy("band").agg(F.min("x").alias("y"), F.count("*").alias("n")).where("n > 1").select("band", "y"))
    return exploded.join(least, "band").where("x <> y").select("x", "y").distinct()


def minhash_dedup(docs: DataFrame, text: str = "text", order: str = "doc_id", n: int = 5, buckets: int = 14, rows: int = 8, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(kept, removed). Documents that share a bucket are taken for duplicates without further proof; texts under n words stay."""
    signed = keep(docs.select(order, signature(F.col(text), n, buckets, rows, seed).alias("signature")))
    labels = components(star_edges(signed, order, "signature", buckets))
    gone = keep(labels.where("node <> label").select(F.col("node").alias(order)))
    return docs.join(gone, order, "left_anti"), docs.join(gone, order, "left_semi")
