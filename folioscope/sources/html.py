"""Posts of forum pages, by the standard library's parser over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import spread

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style"))


class _Element:
    """A tag with its attributes, parent, children and texts in document order."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Element | None) -> None:
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def walk(self) -> Iterator[_Element]:
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += [p for p in reversed(e.parts) if isinstance(p, _Element)]

    def find(self, tags: tuple[str, ...], named: str = "") -> _Element | None:
        hits = (e for e in self.walk() if e is not self and e.tag in tags and (not named or re.search(named, e.attrs.get("class", ""))))
        return next(hits, None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            p = stack.pop()
            if isinstance(p, str):
                out.append(p.strip())
            elif p.tag not in HIDDEN:
                stack += reversed(p.parts)
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = _Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(e)
        if tag not in VOID:
            self.at = e

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def parse_posts(html: str) -> list[tuple[str, str, str, str, int]]:
    """post_id, author, date, content and position of each post of 10 characters and more."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    found = [e for e in tree.root.walk() if e.tag == "article"] or [e for e in tree.root.walk() if e.tag == "div" and re.search("post|comment|article", e.attrs.get("class", ""))]
    out = []
    for k, e in enumerate(found):
        content = (e.find(("div",), "post_content|content|body") or e).text()
        if len(content) < 10:
            continue
        author, time = e.find(("span", "div", "a"), "author|username|user"), e.find(("time",))
        date = (time.attrs.get("datetime") or time.attrs.get("title") or time.text()) if time else ""
        if not date:
            other = e.find(("span", "div"), "date|time|posted|timestamp")
            date = (other.attrs.get("datetime") or other.attrs.get("data-time") or other.text()) if other else ""
        out.append((e.attrs.get("id", f"post_{k}"), author.text() if author else f"User_{k}", date, content, k))
    return out


def posts(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """id, post_id, author, date, content and position of every post; null pages have none."""
    kind = pages.schema[id_col].dataType.simpleString()
    fields = (("post_id", pa.string()), ("author", pa.string()), ("date", pa.string()), ("content", pa.string()), ("position", pa.int32()))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *p) for i, text in enumerate(b.column(html).to_pylist()) for p in parse_posts(text or "")]
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], fields, strict=True))], names=[id_col, *(n for n, _ in fields)])

    return spread(pages.select(id_col, html)).mapInArrow(parse, f"{id_col} {kind}, post_id string, author string, date string, content string, position int")


def title(html):
    """A page's title before the first bar, else its first heading, else empty."""
    first = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, p, 1), "<[^>]*>", "")), F.lit(""))
    return F.coalesce(first(r"(?is)<title[^>]*>([^<|]*)"), first(r"(?is)<h1[^>]*>(.*?)</h1>"), first(r"(?is)<h2[^>]*>(.*?)</h2>"), F.lit(""))
