"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Words are lower-cased runs of letters and digits. Every text is read in windows of 2, 4, 8 ... shingles, each overlapping the next by half, so
that any passage as long as a template lies whole in a window of at most four times the template's length. Window signatures are minima over shifted
tables (as in near-duplicate search); those of all windows of many texts come from one another, a window's from its two halves. A window and a template that
share a band are candidates. With one coordinate a band and BANDS bands, a template that fills a share s of a window's shingles collides with probability
1 - (1 - s) ** BANDS: over 0.999999 for a whole template in the largest window that it is sought in. A candidate is a match if at least `percent` % of the
template's shingles are in the window.

A template of fewer than WIDTH words is one shingle of its own length. Texts are hashed at those lengths too, and every place of that shingle is a
match: it needs no window, and no band can miss it.

Templates are a fixed list of at most MAX_TEMPLATES; they travel with the task. Documents are never shuffled. Texts are read in segments of SEGMENT
shingles that overlap by the largest window, so memory is bounded however long they are.
"""

from __future__ import annotations

import re
import sys
import uuid
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id, mix64, slices
from .license_texts import TEXTS

WIDTH, BANDS, PERCENT, MAX_TEMPLATES = 5, 64, 80, 10_000
UNIVERSE_BITS, SEGMENT = 18, 1 << 15
WORD = re.compile(r"[^\W_]+")

#: Notices and the distinctive paragraphs of common licenses.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "either version 3 of the License, or (at your option) any later version"],
    "GPL-2.0": ["either version 2 of the License, or (at your option) any later version", "Licensed under the GNU General Public License, version 2."],
    "LGPL": ["under the terms of the GNU Lesser General Public License"],
    "AGPL-3.0": ["under the terms of the GNU Affero General Public License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC0": ["has waived all copyright and related or neighboring rights to this work", "CC0 1.0 Universal Public Domain Dedication"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

for _name, _text in TEXTS.items():
    TEMPLATES.setdefault(_name, []).append(_text)

#: Notices that grant no license: they are matches, but not among a document's licenses.
NOTICES = {"All-rights-reserved": ["All rights reserved."]}


def collision_probability(share: float, bands: int = BANDS) -> float:
    """That a window of which the template fills this share of shingles meets it in a band."""
    return 1 - (1 - share) ** bands


def word_hashes(text: str) -> np.ndarray:
    import xxhash

    words = WORD.findall(text)
    return np.fromiter((xxhash.xxh3_64_intdigest(w.lower().encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def shingles(h: np.ndarray, n: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the n-word shingles of words with these hashes, in order; none of fewer words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], percent: int, bands: int):
        self.percent, self.bands = percent, bands
        order = np.random.RandomState(7).permutation(1 << UNIVERSE_BITS).astype(np.int32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: bands - 1]]), bands)
        self.classes: dict[int, dict] = {}
        self.sets = []
        #: Of each set's shingles: the first place in the template, how often they are in it, and all places.
        self.order: list[tuple[np.ndarray, np.ndarray, list[list[int]]]] = []
        #: Templates under WIDTH words: words -> shingle -> names.
        self.short: dict[int, dict[int, list[str]]] = {}
        for name, text in templates:
            h = word_hashes(text)
            if not len(h):
                continue
            if len(h) < WIDTH:
                self.short.setdefault(len(h), {}).setdefault(int(shingles(h, len(h))[0]), []).append(name)
                continue
            s, first, back, times = np.unique(shingles(h), return_index=True, return_inverse=True, return_counts=True)
            spots: list[list[int]] = [[] for _ in s]
            for k, i in enumerate(back.tolist()):
                spots[i].append(k)
            size = 2
            while size < 2 * len(s):
                size *= 2
            at = self.classes.setdefault(size, {"keys": [], "owner": []})
            at["keys"].append(self.signature(s))
            at["owner"].append(len(self.sets))
            self.sets.append((name, s))
            self.order.append((first, times, spots))
        self.largest = max(self.classes, default=0)
        for at in self.classes.values():
            at["keys"], at["owner"] = np.array(at["keys"]), np.array(at["owner"])
            # A table of bits that says of most bands that no template of the class has them: a thousand places for each band of each.
            bits = at["bits"] = min(26, int(len(at["keys"]) * bands * 1024).bit_length())
            at["seen"] = np.zeros(1 << bits, bool)
            at["seen"][self.spots(at["keys"], bits)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(self.bands, np.iinfo(np.int32).max, np.int32)
        for k in range(0, len(hashes), 4096):
            out = np.minimum(out, self.shifted[self.places(hashes[k : k + 4096])].min(axis=0))
        return out

    def occurrences(self, owner: int, hashes: np.ndarray, where: np.ndarray) -> list[tuple]:
        """(first place, last place, distinct shingles, falls) of each occurrence of a set in a window that has these of its shingles at these places.

        Where no shingle is more often in the window than in the template, all are one occurrence. Otherwise it is split: the span with the fewest
        falls (shingles before one of an earlier place in the template), then the shortest, that reaches the percentage is taken with what follows or
        precedes it in the template's order, and then the rest on both sides likewise.
        """
        s = self.sets[owner][1]
        need = -(-self.percent * len(s) // 100)
        first, times, spots = self.order[owner]
        ids = np.searchsorted(s, hashes)
        counts = np.bincount(ids, minlength=len(s))
        if (got := int((counts > 0).sum())) < need or not got:
            return []
        place = first[ids]
        fall = np.concatenate([[0], np.cumsum(place[1:] < place[:-1])]).tolist()
        if (counts <= times).all():
            return [(int(where[0]), int(where[-1]), got, fall[-1])]
        ids, at = ids.tolist(), where.tolist()
        out, open_ = [], [(0, len(ids))]
        while open_:
            lo, hi = open_.pop()
            best, held, i = None, {}, lo
            for j in range(lo, hi):
                held[ids[j]] = held.get(ids[j], 0) + 1
                while held[ids[i]] > 1:
                    held[ids[i]] -= 1
                    i += 1
                a, few, gone = i, len(held), {}
                # Shortest span that ends here: shingles may go from its start while enough are left.
                while few > need and a < j:
                    gone[ids[a]] = gone.get(ids[a], 0) + 1
                    few -= gone[ids[a]] == held[ids[a]]
                    a += 1
                if few >= need:
                    best = min(x for x in (best, (fall[j] - fall[a], at[j] - at[a], a, j)) if x)
            if best is None:
                continue
            _, _, a, b = best
            have = Counter(ids[a : b + 1])
            after, before = spots[ids[b]][0], spots[ids[a]][-1]
            while b + 1 < hi and have[k := ids[b + 1]] < times[k] and (p := next((p for p in spots[k] if p > after), None)) is not None:
                b, after = b + 1, p
                have[k] += 1
            while a > lo and have[k := ids[a - 1]] < times[k] and (p := next((p for p in reversed(spots[k]) if p < before), None)) is not None:
                a, before = a - 1, p
                have[k] += 1
            out.append((at[a], at[b], len(have), fall[b] - fall[a]))
            open_ += [(lo, a), (b + 1, hi)]
        return out

    def spots(self, signatures: np.ndarray, bits: int) -> np.ndarray:
        band = np.arange(self.bands, dtype=np.uint32) * np.uint32(0x85EBCA6B)
        return ((signatures.astype(np.uint32) + band) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, first shingle, end, template) of each window that shares a band with a template; texts are arrays of shingles."""
        step = max(SEGMENT, 2 * self.largest) // max(1, self.largest) * self.largest
        parts = [(t, lo, min(lo + step + self.largest, len(h)), lo + step < len(h)) for t, h in enumerate(texts) for lo in range(0, len(h), step)] if self.largest else []
        group, held = [], 0
        for part in parts:
            group.append(part)
            held += part[2] - part[1]
            if held >= SEGMENT:
                yield from self.of_group(texts, group, step)
                group, held = [], 0
        if group:
            yield from self.of_group(texts, group, step)

    def of_group(self, texts: list[np.ndarray], group: list[tuple], step: int) -> Iterator[tuple[int, int, int, int]]:
        blocks = self.shifted[self.places(np.concatenate([texts[t][lo:hi] for t, lo, hi, _ in group]))]
        count = np.array([hi - lo for _, lo, hi, _ in group])
        size = 2
        while size <= self.largest:
            # Blocks are of size // 2 shingles; a window is two neighbours, or a text's only block.
            begin, half = np.cumsum(count) - count, size // 2
            if size in self.classes:
                windows = np.maximum(count - 1, 1)
                owner = np.repeat(np.arange(len(group)), windows)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
                left = begin[owner] + place
                signs = np.minimum(blocks[left], blocks[np.minimum(left + 1, begin[owner] + count[owner] - 1)])
                at = self.classes[size]
                for w in np.flatnonzero(at["seen"][self.spots(signs, at["bits"])].any(axis=1)):
                    t, lo, hi, more = group[owner[w]]
                    start = lo + int(place[w]) * half
                    if more and start >= lo + step:
                        continue  # the next segment has this window whole
                    for k in at["owner"][(at["keys"] == signs[w]).any(axis=1)]:
                        yield t, start, min(start + size, len(texts[t])), int(k)
            pairs = -(-count // 2)
            owner = np.repeat(np.arange(len(group)), pairs)
            left = begin[owner] + 2 * (np.arange(len(owner)) - np.repeat(np.cumsum(pairs) - pairs, pairs))
            blocks = np.minimum(blocks[left], blocks[np.minimum(left + 1, begin[owner] + count[owner] - 1)])
            count, size = pairs, 2 * size

    def scan(self, texts: list[str]) -> list[list[tuple]]:
        """For each text (license, start, end, percent of the template's shingles) by place, the best window of each template and of overlapping windows."""
        hashed = [word_hashes(t) for t in texts]
        shingled = [shingles(h) for h in hashed]
        seen: list[dict[int, set[tuple]]] = [{} for _ in texts]
        for t, lo, hi, owner in self.candidates(shingled):
            window = shingled[t][lo:hi]
            inside = np.flatnonzero(np.isin(window, self.sets[owner][1]))
            for a, b, got, falls in self.occurrences(owner, window[inside], inside):
                seen[t].setdefault(owner, set()).add((falls, -got, b - a, a + lo, b + lo))
        return [self.resolved(text, h, of) for text, h, of in zip(texts, hashed, seen, strict=True)]

    def resolved(self, text: str, hashed: np.ndarray, seen: dict[int, set[tuple]]) -> list[tuple]:
        """Of overlapping matches the better ones, as code points. Places are of words until here."""
        found, brief = [], []
        for owner, places in seen.items():
            name, s = self.sets[owner]
            taken = Taken()
            for _, got, _, a, b in sorted(places):
                if taken.add(a, b + WIDTH):
                    found.append((-100 * got // len(s), name, a, min(b + WIDTH, len(hashed))))
        for n, names in self.short.items():
            h = shingles(hashed, n)
            for i in np.flatnonzero(np.isin(h, np.fromiter(names, np.uint64, len(names)))).tolist():
                brief += [(100, name, i, i + n) for name in names[int(h[i])]]
        if not found and not brief:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        order = lambda x: (-x[0], -(x[3] - x[2]), x[2], x[1])
        told = lambda rows: sorted(((score, name, spans[a][0], spans[b - 1][1]) for score, name, a, b in rows), key=order)
        taken = Taken()
        return sorted(((name, start, end, score) for score, name, start, end in [*told(found), *told(brief)] if taken.add(start, end)), key=lambda x: x[1])


class Taken:
    """Ranges that don't overlap."""

    def __init__(self):
        self.ranges: list[tuple[int, int]] = []

    def add(self, start: int, end: int) -> bool:
        """Takes a range, unless it overlaps one that is taken."""
        k = bisect_left(self.ranges, (start, end))
        if (k and self.ranges[k - 1][1] > start) or (k < len(self.ranges) and self.ranges[k][0] < end):
            return False
        insort(self.ranges, (start, end))
        return True


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, percent: int = PERCENT, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_matches, licenses and matches (array of license, start, end, percent; code points, end exclusive).

    licenses lists the names found but those of NOTICES, sorted and comma-joined. Of overlapping matches the one with the higher percent, then the longer,
    then the earlier, counts (of one template, the one in the template's order, then the higher percent, then the shorter); templates under WIDTH words give way to all others. Null, empty and wordless texts have none; very long ones are read whole. Repeated rows get the
    same; other columns are not read. Ids are integers or strings.
    """
    listed = sorted((name, text) for name, texts in (TEMPLATES | NOTICES if templates is None else templates).items() for text in texts)
    if len(listed) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    key = uuid.uuid4().hex
    rows = docs.select(as_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").cast("string"))
    match = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("percent", pa.int32())]))

    def run(batches):
        held = sys.__dict__.setdefault("_corpusmill_scanners", {})
        if key not in held:
            held.clear()
            held[key] = Scanner(listed, percent, bands)
        for batch in (b for whole in batches for b in slices(whole)):
            found = [[dict(zip(("license", "start", "end", "percent"), m, strict=True)) for m in of] for of in held[key].scan([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, match)], ["id", "matches"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, matches array<struct<license string, start long, end long, percent int>>")
    names = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["license"]), lambda name: ~name.isin(*NOTICES)))), ",")
    return out.select(F.col("id").alias(id_col), F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), "matches")
