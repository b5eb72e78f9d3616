"""Pages by their DOM: what patterns cannot parse, with the standard library's parser over Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Text(HTMLParser):
    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.depth, self.parts, self.images, self.title, self.in_title = dropped, 0, [], [], None, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.dropped:
            self.depth += 1
        self.in_title = tag == "title"
        if tag == "img" and not self.depth:
            self.images.append(dict(attrs).get("src") or "")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.dropped and self.depth:
            self.depth -= 1
        self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title and self.title is None:
            self.title = data.strip()
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def dom_text(html: Column, dropped: tuple[str, ...] = ("script", "style")) -> Column:
    """Struct (title, text, images) of pages; null text where nothing is left."""
    names = frozenset(dropped)

    @F.pandas_udf("title string, text string, images array<string>")
    def parsed(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            parser = _Text(names)
            parser.feed(page or "")
            parser.close()
            rows.append((parser.title, "\n".join(parser.parts) or None, [s for s in parser.images if s and not s.startswith("data:")][:20]))
        return pd.DataFrame(rows, columns=["title", "text", "images"])

    return parsed(html)
