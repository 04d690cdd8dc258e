"""Articles from HTML pages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values.
NOISE = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "iframe", "button", "svg"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre"}
FIGURE = "[FIGURE OMITTED]"


class _Reader(HTMLParser):
    """One pass: title, meta fields, JSON-LD, and the text of blocks outside noise."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.data, self.blocks = "", {}, [], []
        self._noise, self._in, self._text, self._json = 0, [], [], False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (name := a.get("property") or a.get("name")):
            self.meta.setdefault(name.lower(), a.get("content") or "")
        self._json = tag == "script" and (a.get("type") or "") == "application/ld+json"
        if tag in NOISE and not self._json:
            self._noise += 1
        elif tag in ("figure", "img", "table") and not self._noise:
            self._flush()
            if not self.blocks or self.blocks[-1] != FIGURE:
                self.blocks.append(FIGURE)
        elif tag in BLOCKS:
            self._flush()
        self._in.append(tag) if tag == "title" else None

    def handle_endtag(self, tag):
        if tag == "title" and self._in:
            self._in.pop()
        if tag in NOISE and self._noise and not self._json:
            self._noise -= 1
        if tag == "script":
            self._json = False
        if tag in BLOCKS:
            self._flush()

    def handle_data(self, data):
        if self._json:
            try:
                self.data.append(json.loads(data))
            except ValueError:
                pass
        elif self._in:
            self.title += data
        elif not self._noise:
            self._text.append(data)

    def _flush(self):
        joined = " ".join("".join(self._text).split())
        self._text = []
        if joined:
            self.blocks.append(joined)

    def close(self):
        super().close()
        self._flush()


def read(html: str | None) -> dict:
    r = _Reader()
    r.feed(html or "")
    r.close()
    ld = next((d for d in r.data if isinstance(d, dict)), {})
    author = ld.get("author")
    author = (author[0] if isinstance(author, list) and author else author) or r.meta.get("author", "")
    author = author.get("name", "") if isinstance(author, dict) else author
    return {
        "title": " ".join((r.meta.get("og:title") or ld.get("headline") or r.title).split()), "author": str(author), "date": str(ld.get("datePublished") or r.meta.get("article:published_time") or ""),
        "source": r.meta.get("og:site_name", ""), "paragraphs": r.blocks, "n_paragraphs": len(r.blocks), "body": "\n\n".join(b for b in r.blocks if b != FIGURE),
    }


def articles(pages: DataFrame) -> DataFrame:
    """page_id, url, title, author, date, source, paragraphs, n_paragraphs, body of each page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.concat([f[["page_id", "url"]].reset_index(drop=True), pd.DataFrame([read(h) for h in f["html"]], columns=["title", "author", "date", "source", "paragraphs", "n_paragraphs", "body"])], axis=1)

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, author string, date string, source string, paragraphs array<string>, n_paragraphs int, body string")
