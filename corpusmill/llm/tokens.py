"""Byte-level BPE encoding of whole texts with a per-worker cache of words.

Byte-level BPE never joins a space to the non-space before it, so a text may be cut before any space that follows a
non-space, or that precedes a non-space; likewise between a letter and a mark that white space follows, and around a line break between
non-spaces. The parts' ids, put together, are the text's ids. Texts with a space between two white-space characters, or between one and the
end, are encoded whole. Parts without a space before them carry the mark BARE; texts that hold that character are encoded whole too, and so are
texts that hold one of the tokenizer's added tokens, which become that token's id, as the library has it.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_WORDS = 300_000
CACHED_BYTES = 64 << 20  # of the cached words (UTF-8) and their ids; text without spaces makes words of any length
ENCODED_BYTES = 1 << 20  # of UTF-8 given to the library at once: what it returns takes some hundred bytes a token
BARE = "\x01"
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")  # letters in every Unicode version
_SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
WHOLE = rf"{_SPACE} (?:{_SPACE}|\z)|\x01"
MARKED = r"([A-Za-zÀ-ÖØ-öø-ɏ])([.,!?;:])([ \n]|\z)"
BROKEN = r"([^\s\p{Z}\x{85}\x{1c}-\x{1f}])\n([^\s\p{Z}\x{85}\x{1c}-\x{1f}])"


class Encoder:
    """texts -> ids of `dtype`; no special tokens are added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in t.get_added_tokens_decoder().values()]
        self.whole = "|".join([WHOLE, *map(re.escape, added)])
        size = t.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.starts = np.array([(t.id_to_token(k) or "").startswith("Ġ") for k in range(size)])
        self.by_word = t.normalizer is None and "ByteLevel(add_prefix_space=False" in str(t.pre_tokenizer) and "use_regex=True" in str(t.pre_tokenizer)
        # Words are encoded in lines of many, where an added token with white space could arise.
        self.by_word = self.by_word and not any(re.search(r"\s", x) for x in added)
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the cache's older half; what is found there moves to `words`
        self.held = 0

        if self.by_word:
            self.letters = self.for_letters(path)
            self.line_break = t.encode("\n", add_special_tokens=False).ids

    @staticmethod
    def for_letters(path: str):
        """The same tokenizer for words of letters alone: it cuts before spaces only, and caches no words itself."""
        import json

        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        options = {k: model[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)}
        t = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **options))
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return t

    def plain(self, texts: list[str], tokenizer=None) -> list[bytes]:
        out, ends = [], np.cumsum([len(x.encode()) for x in texts])
        while len(out) < len(texts):
            k = len(out)
            n = max(1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + ENCODED_BYTES, "right")) - k)
            out += [np.array(e.ids, self.dtype).tobytes() for e in (tokenizer or self.tokenizer).encode_batch_fast(texts[k : k + n], add_special_tokens=False)]
        return out

    def in_lines(self, words: list[str], tokenizer, by: str = " ") -> None:
        """Caches words without white space; they go through the tokenizer in long lines, and the token that begins with `by` tells them apart."""
        lines = [words[k : k + 512] for k in range(0, len(words), 512)]
        for line, raw in zip(lines, self.plain([by + by.join(w.removeprefix(BARE) for w in x) if by != " " else " " + " ".join(x) for x in lines], tokenizer), strict=True):
            ids = np.frombuffer(raw, self.dtype)
            at = np.flatnonzero(self.starts[ids] if by == " " else ids == self.line_break[0])
            if len(at) != len(line):
                self.alone(line)
                continue
            begin = at + (by != " ")
            ends = [*at[1:].tolist(), len(ids)]
            size = self.dtype.itemsize
            self.words.update((w, raw[i * size : j * size]) for w, i, j in zip(line, begin.tolist(), ends, strict=True))

    def alone(self, words: list[str]) -> None:
        self.words.update(zip(words, self.plain([w[1:] if w[:1] == BARE else f" {w}" for w in words]), strict=True))

    def learn(self, new: list[str]) -> None:
        """Caches the ids of " " + word, or of a BARE word without that mark."""
        letters, bare, others, odd = [], [], [], []
        for w in new:
            if LATIN.fullmatch(w):
                letters.append(w)
            elif w[:1] == BARE:
                (bare if len(self.line_break) == 1 and LATIN.fullmatch(w, 1) else odd).append(w)
            else:
                (others if w.split() == [w] else odd).append(w)
        self.in_lines(letters, self.letters)
        self.in_lines(bare, self.tokenizer, "\n")
        self.in_lines(others, self.tokenizer)
        self.alone(odd)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is an empty text. Words are told apart in Arrow, so that Python sees each of a batch's words once."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return [np.frombuffer(x, self.dtype) for x in self.plain(texts.to_pylist())]
        aside = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, self.whole)))
        whole = dict(zip(aside.tolist(), self.plain(texts.take(pa.array(aside)).to_pylist()), strict=True))
        if whole:
            texts = pa.array(["" if k in whole else x for k, x in enumerate(texts.to_pylist())], texts.type)
        texts = pc.replace_substring_regex(texts, MARKED, rf"\1 {BARE}\2\3")
        texts = pc.replace_substring_regex(texts, BROKEN, f"\\1 {BARE}\n {BARE}\\2")
        # A text's first word has no space before it either.
        parts = pc.split_pattern(pc.binary_join_element_wise(BARE, texts, ""), " ")
        coded = parts.flatten().dictionary_encode()
        place = np.asarray(coded.indices)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > CACHED_WORDS // 2 or self.held > CACHED_BYTES // 2:
            self.before, self.words, self.held = self.words, {}, 0
        values = list(map(self.words.get, words))
        if new := [k for k, v in enumerate(values) if v is None]:
            self.words.update((words[k], v) for k in new if (v := self.before.get(words[k])) is not None)
            self.learn([words[k] for k in new if words[k] not in self.words])
            for k in new:
                values[k] = self.words[words[k]]
            self.held += pc.sum(pc.binary_length(coded.dictionary.take(pa.array(new)))).as_py() + sum(len(values[k]) for k in new)
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        pool, begin = np.frombuffer(b"".join(values), self.dtype), np.cumsum(size) - size
        length = size[place]
        ends = np.cumsum(length)
        ids = pool[np.repeat(begin[place] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        first = np.asarray(parts.offsets)[:-1] - parts.offsets[0].as_py()
        out = np.split(ids, (ends - length)[first][1:])
        for k, raw in whole.items():
            out[k] = np.frombuffer(raw, self.dtype)
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it lives as long as the Python worker."""
    held = sys.__dict__.setdefault("_corpusmill_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
