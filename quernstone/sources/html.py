"""Article and listing pages as nested rows, with the standard library's parser, and the tables they explode into."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

_VOID = {"br", "img", "meta", "link", "hr", "input", "source", "wbr"}
_SILENT = {"script", "style", "noscript", "template"}
_HEADINGS = {"h1", "h2", "h3", "h4"}
ARTICLE = "page_id long, title string, canonical string, author string, published string, headings array<string>, paragraphs array<struct<index:int,heading:string,text:string>>, cells array<struct<table_index:int,row_index:int,cell_index:int,heading:string,text:string>>, items array<struct<list_index:int,item_index:int,heading:string,text:string>>, links array<struct<href:string,text:string>>, text string"


class _Article(HTMLParser):
    """Text blocks in document order, each under the last heading; embeds and navigation are skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = {"title": "", "canonical": "", "author": "", "published": "", "headings": [], "paragraphs": [], "cells": [], "items": [], "links": []}
        self.heading, self.buffer, self.kind, self.skip, self.depth = "", [], None, 0, []
        self.tables = self.rows = self.columns = self.lists = self.entries = -1
        self.link, self.all = None, []

    def _flush(self):
        text, kind = " ".join("".join(self.buffer).split()), self.kind
        self.buffer, self.kind = [], None
        if not text or kind is None:
            return
        self.all.append(text)
        if kind in _HEADINGS:
            if kind == "h1" and not self.out["title"]:
                self.out["title"] = text
            self.heading = text
            self.out["headings"].append(text)
        elif kind == "p":
            self.out["paragraphs"].append((len(self.out["paragraphs"]), self.heading, text))
        elif kind == "td":
            self.out["cells"].append((self.tables, self.rows, self.columns, self.heading, text))
        elif kind == "li":
            self.out["items"].append((self.lists, self.entries, self.heading, text))
        elif kind == "title":
            self.out["title"] = self.out["title"] or text

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag not in _VOID:
            self.depth.append(tag)
        if tag in _SILENT or tag == "nav" or (tag == "blockquote" and "embed" in a.get("class", "")):
            self.skip += 1
        if self.skip and tag != "link":
            return
        if tag == "meta" and a.get("name") == "author":
            self.out["author"] = a.get("content", "")
        elif tag == "link" and a.get("rel") == "canonical":
            self.out["canonical"] = a.get("href", "")
        elif tag == "time" and not self.out["published"]:
            self.out["published"] = a.get("datetime", "")
        elif tag == "table":
            self.tables, self.rows = self.tables + 1, -1
        elif tag == "tr":
            self.rows, self.columns = self.rows + 1, -1
        elif tag in ("ul", "ol"):
            self.lists, self.entries = self.lists + 1, -1
        if tag in _HEADINGS or tag in ("p", "td", "th", "li", "title"):
            self._flush()
            self.kind = "td" if tag == "th" else tag
            self.columns += tag in ("td", "th")
            self.entries += tag == "li"
        elif tag == "br":
            self.buffer.append(" ")
        elif tag == "a":
            self.link = [a.get("href", ""), ""]

    def handle_endtag(self, tag):
        if tag in self.depth:
            while self.depth and self.depth[-1] != tag:
                self._close(self.depth.pop())
            self._close(self.depth.pop())

    def _close(self, tag):
        if tag in _SILENT or tag == "nav" or (tag == "blockquote" and self.skip):
            self.skip = max(0, self.skip - 1)
        if tag in _HEADINGS or tag in ("p", "td", "th", "li", "title"):
            self._flush()
        if tag == "a" and self.link:
            self.out["links"].append((self.link[0], " ".join(self.link[1].split())))
            self.link = None

    def handle_data(self, data):
        if not self.skip:
            self.buffer.append(data)
            if self.link:
                self.link[1] += data


def parse_article(html: str | None) -> dict:
    p = _Article()
    p.feed(html or "")
    p.close()
    p._flush()
    return {**p.out, "text": "\n".join(p.all)}


def parse_listing(html: str | None, page_url: str, domain: str) -> tuple[list[tuple[str, str]], str | None]:
    """(url, title) of the listing's items, each once and of the domain alone, and the next page."""
    seen, items, following = set(), [], None
    body = re.search(r'<div[^>]*class="[^"]*blog_list[^"]*"[^>]*>(.*)', html or "", re.S)
    for block in re.findall(r'<article[^>]*class="[^"]*item[^"]*"[^>]*>(.*?)</article>', body[1] if body else "", re.S):
        for href, text in parse_article(block)["links"][:1]:
            url = urljoin(page_url, href)
            if urlsplit(url).hostname == domain and url not in seen:
                seen.add(url)
                items.append((url, text))
    m = re.search(r'<a[^>]*rel="next"[^>]*href="([^"]+)"|<a[^>]*href="([^"]+)"[^>]*rel="next"|<a[^>]*class="[^"]*next[^"]*"[^>]*href="([^"]+)"', html or "")
    if m:
        url = urljoin(page_url, next(x for x in m.groups() if x))
        following = url if urlsplit(url).hostname == domain else None
    return items, following


def articles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    names = [x.split(" ")[0] for x in re.split(r", (?=\w+ )", ARTICLE)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b["page_id"], b["html"], strict=True):
                d = parse_article(html)
                for c, keys in (("paragraphs", ("index", "heading", "text")), ("cells", ("table_index", "row_index", "cell_index", "heading", "text")), ("items", ("list_index", "item_index", "heading", "text")), ("links", ("href", "text"))):
                    d[c] = [dict(zip(keys, x, strict=True)) for x in d[c]]
                rows.append({"page_id": page, **d})
            yield pd.DataFrame(rows, columns=names)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInPandas(run, ARTICLE)


def exploded(parsed: DataFrame, part: str) -> DataFrame:
    """One of paragraphs, cells, items or links as rows, with the flag of a recommended section where there is a heading."""
    out = parsed.select("page_id", F.explode(part).alias("x")).select("page_id", "x.*")
    return out.withColumn("is_recommended", t.is_recommended_heading(F.col("heading"))) if "heading" in out.columns else out


def flat_articles(parsed: DataFrame) -> DataFrame:
    """Articles with nested columns as JSON text, as a CSV sink wants them."""
    nested = ("headings", "paragraphs", "cells", "items", "links")
    return parsed.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in parsed.columns])
