"""Decontamination by word n-grams shared with evaluation items. An index is a table (gram, item_id)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import text as T
from .dedup import powers
from .durable import keep

N, LIMIT = 13, 10


def ngram_index(items: DataFrame, n: int = N, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct n-grams of each item."""
    grams = F.array_distinct(T.ngrams(T.simple_words(F.col(text)), n))
    return items.select(F.col(item).alias("item_id"), F.explode(grams).alias("gram"))


#: Low bits of a hash that are asked of the index before a document's n-gram goes to the join: a bitmap of half a megabyte, whatever the index's size.
BUCKETS = 1 << 22
SLICE = 1 << 18  # words that are worked on at once


def _windows(words: Column, n: int, marked: bytes | None = None) -> Column:
    """array<struct<pos, h>>: a 64-bit hash of each n-word window, or of those alone whose bucket is marked."""

    @F.arrow_udf("array<struct<pos:int,h:long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        factors = [np.uint64(p) for p in powers(n)]
        bits = None if marked is None else np.unpackbits(np.frombuffer(marked, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            per = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(per), 0
            found, places, hashes = np.zeros(len(batch), np.int64), [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
                coded = batch.slice(at, to - at).flatten().dictionary_encode()
                h = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.uint64)
                size, doc = max(0, len(h) - n + 1), np.repeat(np.arange(to - at), per[at:to])
                begin = np.cumsum(per[at:to]) - per[at:to]
                with np.errstate(over="ignore"):
                    x = sum((h[k : k + size] * p for k, p in enumerate(factors)), np.zeros(size, np.uint64))
                wanted = doc[:size] == doc[len(h) - size :]
                if bits is not None:
                    wanted &= bits[x & np.uint64(BUCKETS - 1)]
                hit = np.flatnonzero(wanted)
                found[at:to] = np.bincount(doc[hit], minlength=to - at)
                places.append((hit - begin[doc[hit]]).astype(np.int32))
                hashes.append(x[hit].view(np.int64))
                at = to
            rows = pa.StructArray.from_arrays([pa.array(np.concatenate(places)), pa.array(np.concatenate(hashes))], ["pos", "h"])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found)]), pa.int32()), rows)

    return run(words)


def _hashed(grams: DataFrame, n: int) -> DataFrame:
    """(gram, __h), a table: its buckets are collected before it is joined."""
    return keep(grams.select("gram", F.get(_windows(F.split("gram", " "), n), F.lit(0))["h"].alias("__h")))


def _marks(known: DataFrame) -> bytes:
    bits = np.zeros(BUCKETS, bool)
    bits[[r[0] for r in known.select(F.col("__h").bitwiseAND(BUCKETS - 1).alias("b")).distinct().collect()]] = True
    return np.packbits(bits, bitorder="little").tobytes()


def matches(docs: DataFrame, index: DataFrame, n: int = N, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, gram): informative n-grams of documents that are in the index, distinct. Documents send 64-bit hashes to the join, of n-grams whose bucket the index has; Spark broadcasts the index only
    if it is small. Whether a gram is informative is asked of the index alone."""
    known = _hashed(index.select("gram").distinct().where(T.informative(F.col("gram"), n)), n)
    rows = docs.select(F.col(doc), _windows(T.simple_words(F.col(text)), n, _marks(known)).alias("__w")).select(doc, F.explode(F.array_distinct(F.col("__w.h"))).alias("__h"))
    return rows.join(known, "__h").select(doc, "gram")


def gram_counts(docs: DataFrame, index: DataFrame, n: int = N, doc: str = "doc_id", text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """(gram, documents): how many documents hold each n-gram of the index. `found` may be a kept table of matches()."""
    return (matches(docs, index, n, doc, text) if found is None else found).groupBy("gram").agg(F.count("*").alias("documents"))


def shared_ngrams(index: DataFrame, max_items: int = LIMIT) -> DataFrame:
    """n-grams of more than max_items items: templates."""
    return index.groupBy("gram").agg(F.count("*").alias("items")).where(F.col("items") > max_items).select("gram")


def contaminating(index: DataFrame, counts: DataFrame, max_documents: int = LIMIT, max_items: int = LIMIT) -> DataFrame:
    """Matched n-grams that are neither web boilerplate nor templates."""
    return counts.where(F.col("documents") <= max_documents).select("gram").join(shared_ngrams(index, max_items), "gram", "left_anti")


def contaminated(docs: DataFrame, index: DataFrame, counts: DataFrame | None = None, n: int = N, max_documents: int = LIMIT, max_items: int = LIMIT, doc: str = "doc_id", text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """Ids of documents with a match that isn't ignored. Without counts only templates are."""
    ignored = shared_ngrams(index, max_items)
    if counts is not None:
        ignored = ignored.union(counts.where(F.col("documents") > max_documents).select("gram")).distinct()
    found = matches(docs, index, n, doc, text) if found is None else found
    return found.join(ignored, "gram", "left_anti").select(doc).distinct()


def items_with(index: DataFrame, grams: DataFrame) -> DataFrame:
    return index.join(grams.select("gram").distinct(), "gram", "left_semi").select("item_id").distinct()


def covered_fraction(texts: DataFrame, grams: DataFrame, n: int = N, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, covered): the share of words inside an n-gram of `grams`, for texts with at least one."""
    known = _hashed(grams.select("gram").distinct(), n)
    words = texts.select(F.col(key), T.simple_words(F.col(text)).alias("w"))
    at = words.select(key, F.size("w").alias("words"), _windows(F.col("w"), n, _marks(known)).alias("__w")).select(key, "words", F.inline("__w")).withColumnRenamed("h", "__h")
    hits = at.join(known, "__h", "left_semi")
    covered = hits.select(key, "words", F.explode(F.sequence(F.col("pos"), F.col("pos") + n - 1)).alias("word")).distinct()
    return covered.groupBy(key, "words").agg(F.count("*").alias("n")).select(key, (F.col("n") / F.col("words")).alias("covered"))
