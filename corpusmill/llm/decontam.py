"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and runs of white space become one space. An item of m characters may be found with up to k = m * percent // 100
edits. It is split into k + 1 pieces; one piece at least survives any k edits. Neighbouring pieces form pairs (a piece left over is a group of its own, and
longer): if every group had as many edits as pieces, there would be k + 1, so in some group a piece is exact and its partner has one edit at most, which
leaves half of the partner exact, moved by one character at most. An Aho-Corasick automaton finds exact pieces in a document, hits without such a half beside
them are dropped, and Myers' bit-parallel algorithm takes the least edit distance between the item and the text around each hit that is left. No step loses a match.

Items under `min_chars` characters allow no edit: they must stand exactly, between word boundaries. Items under LINE_CHARS characters, which ordinary sentences
hold, must be a line of the document.

Items are a query set: they go to the executors in blocks of at most about BLOCK_CHARS characters, however many there are. Each block is one pass over all
documents; the driver and a Python worker hold one block at a time. Documents are never shuffled, so a hot passage or item costs nothing but its own verification.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_id, slices

BLOCK_CHARS = 4_000_000
PERCENT, MIN_CHARS, LINE_CHARS = 10, 40, 16


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def distance(item: str, masks: dict[str, int], text: str) -> int:
    """The least edit distance between the item and any part of the text."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best


def pieces_of(m: int, k: int) -> list[tuple[int, int, int, int]]:
    """(start, end, partner's start, partner's end) of the k + 1 pieces of m characters. Without a partner its bounds are equal; such a piece is half as long again."""
    weight = [2] * (k + 1)
    if k % 2 == 0:
        weight[-1] = 3
    at, cuts = 0, [0]
    for w in weight:
        at += w
        cuts.append(m * at // sum(weight))
    bounds = list(zip(cuts, cuts[1:], strict=False))
    return [(*b, *(bounds[j ^ 1] if j ^ 1 < len(bounds) else (0, 0))) for j, b in enumerate(bounds)]


def half_beside(text: str, start: int, end: int, item: str, a: int, pa_: int, pb: int) -> bool:
    """Whether half of the partner item[pa_:pb] of the piece that begins at `a` in the item stands where one edit at most leaves it; text[start:end] is that piece."""
    mid, size = (pa_ + pb) // 2, pb - pa_
    if pa_ > a:
        return text.startswith(item[pa_:mid], end) or text.find(item[mid:pb], end + mid - pa_ - 1, end + size + 1) >= 0
    near = start - (pb - mid)
    return (near >= 0 and text.startswith(item[mid:pb], near)) or text.find(item[pa_:mid], max(0, start - size - 1), max(0, near + 1)) >= 0


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple], percent: int, min_chars: int):
        import ahocorasick

        self.items, pieces = [], {}
        #: Items that must be a whole line.
        self.lines: dict[str, list[int]] = {}
        for name, text in items:
            if not (m := len(text := normal(text))):
                continue
            here, k = len(self.items), m * percent // 100 if m >= min_chars else 0
            masks: dict[str, int] = {}
            if m < min(LINE_CHARS, min_chars):
                self.lines.setdefault(text, []).append(here)
            elif m < min_chars:
                pieces.setdefault(text, []).append((here, m, 0, 0))
            else:
                for i, c in enumerate(text):
                    masks[c] = masks.get(c, 0) | 1 << i
                for a, b, *partner in pieces_of(m, k):
                    pieces.setdefault(text[a:b], []).append((here, b, *partner))
            self.items.append((name, text, masks, k))
        self.found = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.found.add_word(piece, (len(piece), where))
        self.any = bool(pieces)
        if pieces:
            self.found.make_automaton()

    def leaks(self, text: str | None) -> Iterator[tuple]:
        """(item, distance) of each item found in the text, in item order."""
        raw, text = text, normal(text)
        if not self.items or not text:
            return
        starts: dict[int, set[int]] = {}
        for line in raw.split("\n") if self.lines else ():
            for i in self.lines.get(normal(line), ()):
                starts.setdefault(i, set()).add(0)
        for last, (size, where) in self.found.iter(text) if self.any else ():
            end = last + 1
            for i, b, p, q in where:
                item = self.items[i][1]
                if p == q or half_beside(text, end - size, end, item, b - size, p, q):
                    starts.setdefault(i, set()).add(end - b)
        for i in sorted(starts):
            name, item, masks, k = self.items[i]
            if not masks:
                if item in self.lines or any(not (text[s - 1 : s].isalnum() or text[s + len(item) : s + len(item) + 1].isalnum()) for s in starts[i]):
                    yield name, 0
                continue
            at, best = sorted(starts[i]), k + 1
            first = last = at[0]
            for x in [*at[1:], None]:
                if x is not None and x - last <= 2 * k:
                    last = x
                    continue
                best = min(best, distance(item, masks, text[max(0, first - k) : last + len(item) + k]))
                if best == 0:
                    break
                first = last = x
            if best <= k:
                yield name, best


def _blocks(items: DataFrame, id_col: str, text_col: str) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks, and lists of (id, text) of at most about BLOCK_CHARS characters each, read one at a time."""
    rows = items.select(as_id(items, id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").distinct()
    n = max(1, -(-int(rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // BLOCK_CHARS))
    of = lambda b: rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
    return n, (sorted(((r["id"], r["text"]) for r in of(b).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])) for b in range(n))


def _matcher(key: str, block, percent: int, min_chars: int) -> Matcher:
    """The worker's automaton for a broadcast block; it holds no other."""
    held = sys.__dict__.setdefault("_corpusmill_matchers", {})
    if key not in held:
        held.clear()
        held[key] = Matcher(block.value, percent, min_chars)
    return held[key]


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, min_chars: int = MIN_CHARS, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, item_col, distance): one row for each document row and item found in it, with the least edit distance.

    Null and empty texts match nothing, on either side; very long ones are searched whole. Repeated document rows give repeated rows; rows of one item id with
    different texts are items of their own. Null ids pass through. Ids are integers or strings. With more than one block of items the matches of each are a
    table in the shared folder.
    """
    if id_col == item_col:
        raise ValueError("id_col and item_col must differ")
    spark = docs.sparkSession
    rows = docs.select(as_id(docs, id_col).alias("a"), F.col(f"`{text_col}`").cast("string"))
    scratch, (n, blocks) = Scratch(spark, "leaks"), _blocks(items, item_col, text_col)
    doc_type, item_type = rows.schema["a"].dataType.simpleString(), items.select(as_id(items, item_col).alias("b")).schema["b"].dataType.simpleString()
    kinds = [pa.string() if t == "string" else pa.int64() for t in (doc_type, item_type)] + [pa.int32()]
    out = None
    for block in blocks:
        key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

        def run(batches, key=key, sent=sent):
            match = _matcher(key, sent, percent, min_chars)
            for batch in (b for whole in batches for b in slices(whole)):
                found = [(doc, *leak) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for leak in match.leaks(text)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], ["a", "b", "c"])

        part = rows.mapInArrow(run, f"a {doc_type}, b {item_type}, c int").toDF(id_col, item_col, "distance")
        if n > 1:
            part = scratch.keep(part)
            sent.destroy()
        out = part if out is None else out.union(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, min_chars: int = MIN_CHARS, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no item is found. Null and empty texts stay, as do rows with null ids that hold no item.

    With one block of items rows are filtered where they are read. With more, each block's pass writes the SHA-256 of the texts that hold an item of it, and an
    anti-join on it removes them.
    """
    spark, names = docs.sparkSession, docs.columns
    scratch, (n, blocks) = Scratch(spark, "leaks"), _blocks(items, item_col, text_col)
    at, plain = names.index(text_col), docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = F.col(f"c{at}").cast("string")
    gone = None
    for block in blocks:
        key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

        def run(batches, at=at if n == 1 else 0, holds=n > 1, key=key, sent=sent):
            match = _matcher(key, sent, percent, min_chars)
            for batch in (b for whole in batches for b in slices(whole)):
                yield batch.filter(pa.array([(next(match.leaks(t), None) is not None) == holds for t in batch.column(at).to_pylist()], pa.bool_()))

        if n == 1:
            return plain.mapInArrow(run, plain.schema).toDF(*names)
        found = plain.select(text.alias("t")).where("t is not null").mapInArrow(run, "t string")
        part = scratch.keep(found.select(F.sha2("t", 256).alias("__leak")).distinct())
        sent.destroy()
        gone = part if gone is None else gone.union(part)
    return plain.join(gone.distinct(), F.sha2(text, 256) == F.col("__leak"), "left_anti").toDF(*names)
