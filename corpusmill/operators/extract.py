"""Main text of web pages, with a status for each page: forwarded, dropped (no text), timeout or extraction_error."""

from __future__ import annotations

import signal
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.column import Column

SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "iframe", "button", "select"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}
AD_WORDS = ("advert", "sidebar", "cookie", "breadcrumb", "related", "share", "comment", "promo")


class _Main(HTMLParser):
    """Blocks of text outside skipped elements; those inside article or main are apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.skip = self.inner = 0
        self.now: list[str] = []
        self.block = ""
        self.found: list[tuple[bool, str, str]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.now).split())
        if text:
            self.found.append((self.inner > 0, self.block, text))
        self.now, self.block = [], ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
        if tag in VOID:
            return
        label = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        hidden = tag in SKIPPED or any(w in label for w in AD_WORDS)
        self.skip += hidden
        self.inner += tag in ("article", "main")
        self.stack.append((tag, hidden))
        if tag in BLOCKS or tag in ("div", "section", "article", "main", "body", "ul", "ol", "table", "tr"):
            self.flush()
            self.block = tag

    def handle_endtag(self, tag):
        if tag not in (t for t, _ in self.stack):
            return
        if tag in BLOCKS or tag in ("div", "section", "article", "main"):
            self.flush()
        while self.stack:
            name, hidden = self.stack.pop()
            self.skip -= hidden
            self.inner -= name in ("article", "main")
            if name == tag:
                break

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


def main_text(page: str) -> str | None:
    """Blocks of the article, or of the page if it has none, one a line; loose text of under five words and repeats of a line are left out."""
    parser = _Main()
    parser.feed(page)
    parser.close()
    parser.flush()
    blocks = [x for x in parser.found if x[0]] or parser.found
    lines = [text for _, tag, text in blocks if tag in BLOCKS or len(text.split()) >= 5]
    return "\n".join(dict.fromkeys(lines)) or None


def extract(page: Column, extractor: Callable[[str], str | None] = main_text, timeout: float = 1.0) -> Column:
    """struct<text, status>. A page over the time limit is interrupted in its worker, one that raises is counted, and the run goes on. Null pages are dropped."""

    @F.pandas_udf("text string, status string")
    def run(pages: pd.Series) -> pd.DataFrame:
        def late(*_):
            raise TimeoutError

        old = signal.signal(signal.SIGALRM, late)
        rows = []
        try:
            for page in pages:
                try:
                    signal.setitimer(signal.ITIMER_REAL, timeout)
                    text = extractor(page) if page else None
                    rows.append((text, "forwarded") if text and text.strip() else (None, "dropped"))
                except TimeoutError:
                    rows.append((None, "timeout"))
                except Exception:
                    rows.append((None, "extraction_error"))
                finally:
                    signal.setitimer(signal.ITIMER_REAL, 0)
        finally:
            signal.signal(signal.SIGALRM, old)
        return pd.DataFrame(rows, columns=["text", "status"], dtype=object)

    return run(page)
