"""Text rewrites: symbol lines, personal data, broken encodings."""

from __future__ import annotations

import html
import ipaddress
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import text as T
from ..functions.text import hash64

_ALNUM = "A-Za-z0-9"
_ATOM = f"[{_ALNUM}#!$&%*'/+?=_^{{`~}}|-]+"
_REST = f"(?:[{_ALNUM}-]*[{_ALNUM}])?"
_NAME = f"[{_ALNUM}]{_REST}"
EMAIL = rf"\b{_ATOM}(?:\.{_ATOM})*@(?:{_NAME}\.)+[A-Za-z]{_REST}"
_BYTE = "(?:" + "|".join(("25[0-5]", "2[0-4][0-9]", "1[0-9][0-9]", "[1-9]?[0-9]")) + ")"
IPV4 = r"(?<![0-9])(?<![0-9]\.)" + r"\.".join([_BYTE] * 4) + r"(?!\.?[0-9])"
MAIL_STAND_INS = tuple(f"{who}@example.{top}" for who, top in (("email", "com"), ("firstname.lastname", "org")))
IP_STAND_INS = tuple(f"{net}.{host}" for net, host in (("192.0.2", 1), ("198.51.100", 23), ("203.0.113", 42)))  # the documentation networks


def symbol_lines(text: Column, symbols: str = T.MARKS, paragraph_break: bool = False) -> Column:
    """Lines of symbols and white space alone go, blank lines stay; with paragraph_break each run of them leaves one empty line."""
    only = rf"^[{T.escaped(symbols)}{T.SPACE}]*\z"
    is_symbol = lambda x: x.rlike(only) & ~T.blank(x)

    def of(lines: Column) -> Column:
        marked = F.transform(lines, lambda x: F.struct(x.alias("line"), is_symbol(x).alias("symbol")))

        def left(rows: Column) -> Column:
            begins = lambda x, i: x["symbol"] & ~F.coalesce(F.get(rows, i - 1)["symbol"], F.lit(False))
            stays = F.filter(rows, lambda x, i: ~x["symbol"] | (begins(x, i) if paragraph_break else F.lit(False)))
            return F.array_join(F.transform(stays, lambda x: F.when(x["symbol"], "").otherwise(x["line"])), "\n")

        return T.let(marked, left)

    return T.let(F.split(text, "\n"), of)


def mask_pii(text: Column, emails: bool = True, ips: bool = True, public_only: bool = True) -> Column:
    """E-mail addresses, then IPv4 addresses, by stand-ins that a hash of the match picks, so equal addresses stay equal. With public_only, addresses that aren't globally routable stay."""
    stand_in = lambda found, choices: choices[hash64(found) % len(choices)]

    def of_ip(m: re.Match) -> str:
        return m[0] if public_only and not ipaddress.ip_address(m[0]).is_global else stand_in(m[0], IP_STAND_INS)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        mail, ip = re.compile(EMAIL), re.compile(IPV4)

        def one(t):
            if t is None:
                return None
            if emails and "@" in t:
                t = mail.sub(lambda m: stand_in(m[0], MAIL_STAND_INS), t)
            return ip.sub(of_ip, t) if ips else t

        return texts.map(one, na_action="ignore")

    # Only texts that may hold an address leave the JVM.
    return F.when(text.contains("@") | text.rlike(r"[0-9]\.[0-9]"), mask(F.when(text.contains("@") | text.rlike(r"[0-9]\.[0-9]"), text))).otherwise(text)


def mask_pii_constant(text: Column, email: str = "email@example.com", ip: str = "192.0.2.1") -> Column:
    """The same patterns without a user function: each match becomes one constant."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, email), IPV4, ip)


def fix_text(text: str, normalization: str | None = "NFC", unescape: str | bool = "auto") -> str:
    """Repairs UTF-8 read as Latin-1 or Windows-1252, HTML entities (auto: only without a `<`), control characters; ligatures, widths, quotes and line breaks stay. Uses ftfy where installed."""
    try:
        import ftfy

        options = {"fix_latin_ligatures": False, "fix_character_width": False, "uncurl_quotes": False, "fix_line_breaks": False}
        return ftfy.fix_text(text, config=ftfy.TextFixerConfig(unescape_html=unescape, normalization=normalization, **options))
    except ModuleNotFoundError:
        pass
    if unescape is True or (unescape == "auto" and "<" not in text):
        text = html.unescape(text)
    for _ in range(3):
        if not re.search("[\x80-\xff€-™]", text):
            break
        for codec in ("latin-1", "cp1252"):
            try:
                better = text.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            if better != text:
                text = better
                break
        else:
            break
    text = re.sub("[\x00-\x08\x0b\x0e-\x1f\x7f﻿]", "", text)
    return unicodedata.normalize(normalization, text) if normalization else text


def fix_encoding(text: Column, normalization: str | None = "NFC", unescape: str | bool = "auto") -> Column:
    @F.pandas_udf("string")
    def fix(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fix_text(t, normalization, unescape), na_action="ignore")

    return fix(text)


def flatten(text: Column) -> Column:
    """One line."""
    return F.array_join(T.split_lines(T.strip(text)), " ")


PREVIEW_WIDTH = 300


def preview(text: str, width: int = PREVIEW_WIDTH) -> str:
    """One line of at most `width` user-perceived characters, with … if cut."""
    import regex

    clusters = regex.findall(r"\X", " ".join(text.split()))
    return "".join(clusters) if len(clusters) <= width else "".join(clusters[: width - 1]).rstrip() + "…"

