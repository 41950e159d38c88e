"""Packing of token streams into sequences: bounded-space online best fit, per partition, then a merge of leftovers.

Each partition keeps at most `windows` open windows. A document's full sequences leave at once; its rest goes to
the window that it fits best. If none fits and all windows are open, the fullest leaves: filled up with the head of the rest
when more than `max_pad` places are free, padded otherwise. What is still open at the end of a partition is merged in
groups of partitions by the same rule; the last open windows of a group become one stream, cut into sequences, and its
rest into powers of two. So the space held is bounded everywhere and padding is at most max_pad of `length` places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_id, sized_slices
from .tokens import encoder

FIELDS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
MERGED_PARTS = 16


class Windows:
    """The open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, length: int, windows: int, max_pad: int):
        self.next_id, self.length, self.windows, self.max_pad = first_id, length, windows, max_pad
        self.open: list[list] = []
        self.free: list[int] = []
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self.emit([(doc, start, ids[: self.length], total)])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            fits = [(free, k) for k, free in enumerate(self.free) if free >= len(ids)]
            if fits:
                k = min(fits)[1]
                self.open[k].append((doc, start, ids, total))
                self.free[k] -= len(ids)
                if not self.free[k]:
                    self.close(k)
                return
            if len(self.open) < self.windows:
                self.open.append([])
                self.free.append(self.length)
                continue
            k = min(range(len(self.free)), key=self.free.__getitem__)
            if (n := self.free[k]) > self.max_pad:
                self.open[k].append((doc, start, ids[:n], total))
                start, ids = start + n, ids[n:]
            self.close(k)

    def close(self, k: int) -> None:
        self.emit(self.open.pop(k))
        self.free.pop(k)

    def flush(self) -> None:
        """What is open becomes one stream, cut into sequences, its rest into powers of two."""
        stream = [p for pieces in self.open for p in pieces]
        left, self.open, self.free = sum(len(p[2]) for p in stream), [], []
        size, room, now = 0, 0, []
        for doc, start, ids, total in stream:
            while len(ids):
                if not room:
                    room = size = min(self.length, 1 << (left.bit_length() - 1))
                n = min(room, len(ids))
                now.append((doc, start, ids[:n], total))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if not room:
                    self.emit(now)
                    now = []

    def taken(self, id_type: pa.DataType = TYPES[0]) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, [id_type, *TYPES[1:]], strict=True)], FIELDS)


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 1024, windows: int = 64, max_pad: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    A document is its text's ids (null text: none) and end_id. ids are little-endian unsigned 32-bit integers, start counts the document's ids
    before the piece, offset the sequence's. Each id lies in one piece. `length` must be a power of two. An empty table gives no
    rows; null and repeated ids are packed like others; doc ids are integers or strings. A very long document is cut over many sequences. Which documents share a
    sequence, and sequence_id, depend on how the input is partitioned; ids of sequences are unique, not gapless.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = docs.select(as_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    id_type, none = (pa.string(), "") if kind == "string" else (pa.int64(), 0)
    schema = f"doc_id {kind}, {SCHEMA}"

    def run(batches):
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        packed = Windows(part << 32, length, windows, max_pad)
        for batch in (b for whole in batches for b in sized_slices(whole, 1)):
            for doc, found in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = np.append(found, encode.dtype.type(end_id))
                packed.add(doc, 0, ids, len(ids))
            if packed.rows:
                yield packed.taken(id_type)
        # A leftover piece has a negative sequence id that tells its group of partitions.
        rows = [(doc, start, len(ids), ids.astype("<u4").tobytes(), total, -1 - part // MERGED_PARTS, 0) for pieces in packed.open for doc, start, ids, total in pieces]
        packed.rows = rows
        yield packed.taken(id_type)

    def merge(table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or none, r["start"], r["ids"]))
        if not rows:
            return pa.Table.from_batches([Windows(0, length, windows, max_pad).taken(id_type)])
        packed = Windows((1 << 30) - rows[0]["sequence_id"] << 32, length, windows, max_pad)
        for r in rows:
            packed.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
        packed.flush()
        return pa.Table.from_batches([packed.taken(id_type)])

    scratch = Scratch(docs.sparkSession, "packing")
    held = scratch.keep(rows.mapInArrow(run, schema))
    left = held.where("sequence_id < 0").groupBy("sequence_id").applyInArrow(merge, schema)
    return held.where("sequence_id >= 0").unionByName(left)
