"""Text functions as column expressions; the plain-Python forms that executors need sit beside them.

Stripping, blank texts and splitting at white space mean what str.isspace() accepts (SPACE); between words and in simplified texts white
space is the Unicode property (WHITE), which lacks the four separators 1C to 1F.
"""

from __future__ import annotations

import string
from functools import cache, reduce
from operator import or_

from pyspark.sql import functions as F
from pyspark.sql.column import Column

SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITE = SPACE.replace(r"\x1C-\x20", r"\x20")
_WORD = r"\p{L}\p{M}\p{N}_"
WORDS = rf"[{_WORD}]+(?:['’][{_WORD}]+)*|[^{_WORD}{WHITE}]"
#: The same without ways back, which find nothing else: an apostrophe that no word character follows ends a word either way.
_WORDS_JAVA = rf"[{_WORD}]++(?:['’][{_WORD}]++)*+|[^{_WORD}{WHITE}]"
#: ASCII punctuation and the marks of other scripts that count as symbols.
MARKS = string.punctuation + "".join(map(chr, (
    0x2026, 0x2014, 0x2013, 0x201C, 0x201D, 0x2018, 0x2019, 0xAB, 0xBB, 0x201E, 0x3001, 0x3002, 0xFF0C, 0xFF0E, 0xFF01, 0xFF1F, 0xFF1A, 0xFF1B,
    0xFF08, 0xFF09, 0x3010, 0x3011, 0x300A, 0x300B, 0x300C, 0x300D,
)))


def escaped(chars: str) -> str:
    """A character class body that Java and RE2 read alike."""
    return "".join(f"\\x{{{ord(c):X}}}" for c in chars)


MARK_CLASS = escaped(MARKS)


@cache
def terminal_class() -> str:
    """The body of a class of all Unicode sentence terminals, as ranges."""
    import regex

    ends = [k for k in range(0x110000) if not 0xD800 <= k < 0xE000 and regex.match(r"\p{Sentence_Terminal}", chr(k))]
    runs: list[list[int]] = []
    for k in ends:
        if runs and runs[-1][1] == k - 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in runs)


def let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


#: The characters of SPACE. Trimming looks at the ends of a text alone; a pattern for the same would be tried at every character.
SPACES = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def blank(text: Column) -> Column:
    return lstrip(text) == ""


def begins_alnum(word: Column) -> Column:
    """Whether the first character is an ASCII letter or digit: two comparisons of bytes, where a pattern needs a decoded copy of each word."""
    return ((word >= "0") & (word < ":")) | begins_letter(word)


def begins_letter(word: Column) -> Column:
    """Whether the first character is an ASCII letter."""
    return ((word >= "a") & (word < "{")) | ((word >= "A") & (word < "["))


def split_lines(text: Column) -> Column:
    """Lines as str.splitlines() gives them."""
    # A single character is split at without a pattern; few texts hold another line break.
    rare = reduce(or_, [text.contains(c) for c in "\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029"])
    parts = F.when(rare, F.split(text, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]", -1)).otherwise(F.split(text, "\n", -1))
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def split_words(text: Column) -> Column:
    """Words (letters, marks, digits, _ and inner apostrophes) and single symbols, in order."""
    return F.regexp_extract_all(text, F.lit(_WORDS_JAVA), 0)


def split_indic_words(text: Column) -> Column:
    """Words between spaces, punctuation and danda apart, number runs like `1 , 000` put together again. Line breaks don't separate words."""
    apart = F.regexp_replace(text, f"([{escaped(string.punctuation)}\\x{{964}}\\x{{965}}])", " $1 ")
    apart = F.regexp_replace(apart, "\t[ \t]*+| [ \t]++", " ")  # single spaces stay
    # Within a run of `digits mark digits ...` no space stays: before a mark that digits follow, and after a mark that such digits precede.
    joined = F.regexp_replace(apart, r" (?<=[0-9] )(?=[,.:/] [0-9])", "")
    joined = F.regexp_replace(joined, r" (?<=[0-9][,.:/] )(?=[0-9])", "")
    return F.filter(F.transform(F.split(joined, " "), strip), lambda w: w != "")


def ends_sentence(line: Column) -> Column:
    # Of the last character alone, so that the class isn't tried at every other.
    return F.right(rstrip(line), F.lit(1)).rlike(f"[{terminal_class()}]")


def simplify_text(text: Column) -> Column:
    """Lower case, numbers as 0, punctuation as spaces, single spaces, no space at the ends."""
    text = F.regexp_replace(F.lower(text), r"\p{Nd}+(?:[,.]\p{Nd}+)*", "0")
    # Each mark run or other white space becomes a space first, so that single spaces, the most, cost no replacement. A class of many ranges is asked only of characters that may be in it.
    spaced = F.regexp_replace(text, rf"\p{{P}}++|[\x09-\x0D\x{{85}}\x{{A0}}]|(?=[\x{{1680}}-\x{{3000}}])[{WHITE}]", " ")
    return strip(F.regexp_replace(spaced, " {2,}", " "))


def simple_words(text: Column) -> Column:
    return let(simplify_text(text), lambda t: F.when(t == "", F.array().cast("array<string>")).when(reduce(or_, map(t.contains, "\x1c\x1d\x1e\x1f")), F.split(t, rf"[{SPACE}]+")).otherwise(F.split(t, " ")))


def ngrams(words: Column, n: int) -> Column:
    """All n-word windows, joined by spaces."""
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(words, lambda w: F.when(F.size(w) >= n, windows(w)).otherwise(F.array().cast("array<string>")))


def ngram_hashes(words: Column, n: int) -> Column:
    """A 64-bit hash of each n-word window."""
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(F.slice(h, i, n)))
    hashed = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), windows)
    return let(words, lambda w: F.when(F.size(w) >= n, hashed(w)).otherwise(F.array().cast("array<bigint>")))


def informative(gram: Column, n: int) -> Column:
    """Whether at least half of the n words have more than one character."""
    return 2 * F.size(F.filter(F.split(gram, " "), lambda w: F.length(w) > 1)) >= n


def count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def chars(items: Column) -> Column:
    """Characters of all strings of an array."""
    return F.length(F.array_join(items, "")).cast("long")


def count_sentences(line: Column) -> Column:
    """Sentences by rule: a mark . ! ? … (and closing quotes or brackets) before white space and more text ends one."""
    return F.when(blank(line), F.lit(0)).otherwise(F.regexp_count(line, F.lit(rf"[.!?…]+[\"'”’)\]]*[{SPACE}]+[^{SPACE}]")) + 1)


def host_of(url: Column) -> Column:
    """Lower-case host without a leading www.; null for what is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def md5_64(text: Column) -> Column:
    """The first 64 bits of the MD5, as decimal(20,0)."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def hash64(text: str) -> int:
    """Little-endian 64 bits of BLAKE2b; for executors."""
    from hashlib import blake2b

    digest = blake2b(digest_size=8)
    digest.update(text.encode("utf-8", "surrogatepass"))
    return int.from_bytes(digest.digest(), "little")


def indic_words(text: str) -> list[str]:
    """split_indic_words for executors."""
    import re

    apart = re.sub("\t[ \t]*| [ \t]+", " ", re.sub("([" + re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + "\u0964\u0965])", r" \1 ", text))
    joined = re.sub(" (?<=[0-9][,.:/] )(?=[0-9])", "", re.sub(" (?<=[0-9] )(?=[,.:/] [0-9])", "", apart))
    return [w for w in (x.strip() for x in joined.split(" ")) if w]
