"""Paragraphs of HTML pages: the text between block elements, in Arrow batches over the standard library's tokeniser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from .udf import arrow_udf

# Elements whose text does not count, and elements that end a paragraph.
SILENT = ("script", "style", "svg")
BLOCK = ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "section", "article", "figcaption", "caption", "table", "ul", "ol", "pre", "blockquote", "details", "summary", "br", "header", "footer", "main", "aside", "nav", "dt", "dd", "figure", "body", "html", "head", "title")
# End of fixed values.
CUT = "\x00"


class _Text(HTMLParser):
    """Gathers text and marks where a block element starts or ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self._tag(tag, 1)

    def handle_endtag(self, tag):
        self._tag(tag, -1)

    def _tag(self, tag: str, step: int) -> None:
        if tag in SILENT:
            self.depth = max(0, self.depth + step)
        elif tag in BLOCK:
            self.parts.append(CUT)

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data.replace(CUT, " "))


def paragraphs_of(page: str) -> list[str]:
    p = _Text()
    p.feed(page)
    p.close()
    return [flat for part in "".join(p.parts).split(CUT) if (flat := " ".join(part.split()))]


@arrow_udf("array<string>")
def html_paragraphs(page: pd.Series) -> pd.Series:
    """The paragraphs of a page, white space collapsed, in order; null has none."""
    return page.map(lambda x: paragraphs_of(x) if x is not None else [])
