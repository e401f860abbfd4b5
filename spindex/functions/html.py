"""HTML -> (text, hrefs) as an Arrow UDF.

Parsing HTML is the one step with no Spark built-in; it runs as an Arrow-batched
UDF (without pandas, which every worker would load) around a small forward
scanner (one pass per page yields both the visible text and the raw ``href`` list).  Everything after it (explode,
filters, joins) is native Spark.

Text rules: elements ``style script head title meta`` and any element that
carries a ``document`` attribute are removed with their content; the
remaining text nodes are joined with a space, whitespace runs collapse to one
space, NUL characters are removed.  ``hrefs`` lists the ``href`` of every
``<a>`` element in document order, duplicates kept, missing values skipped
later by the outlink filter.

The scanner never goes back: every step starts where the last one ended, and a
tag, quote, comment or raw-text element that is never closed ends the page's
markup there (what is inside an unclosed tag is dropped).  Time is linear in the
page, whatever is in it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REMOVED = frozenset({"style", "script", "head", "title", "meta"})
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input",
                   "link", "meta", "param", "source", "track", "wbr"})
# Start tags that imply the end of an unclosed <head>.
_BODY_START = frozenset({"body", "article", "div", "p", "nav", "main", "section",
                         "h1", "h2", "h3", "ul", "ol", "table", "a", "span", "footer"})
# Elements without markup inside: text up to their end tag, with or without character references.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE)
            for name in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")}
_REFERENCES_IN_RAW = frozenset({"title", "textarea"})

PARSED_HTML_TYPE = T.StructType([T.StructField("text", T.StringType()),
                                 T.StructField("hrefs", T.ArrayType(T.StringType()))])


_NAME = re.compile(r"[^\s/>]*")
_BETWEEN = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_TAG = re.compile(r"<(?=[A-Za-z/!?])")

TEXT, START, END = "text", "start", "end"


def _attributes(html: str, at: int):
    """From behind a tag's name: its attributes, whether it closes itself, and the place behind it (None: never closed)."""
    found: list[tuple[str, str | None]] = []
    while True:
        at = _BETWEEN.match(html, at).end()
        if at >= len(html):
            return None
        if html[at] == ">":
            return found, html[at - 1] == "/", at + 1
        name = _ATTRIBUTE.match(html, at)
        at, value = name.end(), None
        equals = _EQUALS.match(html, at)
        if equals:
            at = equals.end()
            quote = html[at:at + 1]
            if quote in ('"', "'"):
                close = html.find(quote, at + 1)
                if close < 0:
                    return None
                value, at = html[at + 1:close], close + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare.group(), bare.end()
        found.append((name.group().lower(), None if value is None else unescape(value)))


def scan(html: str) -> Iterator[tuple]:
    """``(TEXT, text)``, ``(START, name, attributes, closes itself)`` and ``(END, name)`` in order."""
    at, text = 0, 0  # the place reached, and where the open stretch of text began

    def stretch(end: int) -> Iterator[tuple]:
        if end > text:
            yield TEXT, unescape(html[text:end])

    while True:
        opened = _TAG.search(html, at)
        if opened is None:
            yield from stretch(len(html))
            return
        begin, kind = opened.start(), html[opened.end()]
        if kind == "/" and not html[begin + 2:begin + 3].strip():
            if begin + 2 >= len(html):  # "</" and nothing more is text
                at = len(html)
                continue
        yield from stretch(begin)
        if kind in "!?" or (kind == "/" and not (html[begin + 2].isascii() and html[begin + 2].isalpha())):
            if html.startswith("<!--", begin):
                short = next((x for x in ("<!-->", "<!--->") if html.startswith(x, begin)), None)
                close = _COMMENT_END.search(html, begin + 4) if short is None else None
                at = begin + len(short) if short else close.end() if close else len(html)
            else:
                close_at = html.find(">", begin)
                at = close_at + 1 if close_at >= 0 else len(html)
            text = at
            continue
        name_at = _NAME.match(html, begin + (2 if kind == "/" else 1))
        name = name_at.group().lower()
        rest = _attributes(html, name_at.end())
        if rest is None:
            return
        attributes, closes, at = rest
        text = at
        if kind == "/":
            yield END, name
            continue
        yield START, name, attributes, closes
        if name in _RAW_END and not closes:
            close = _RAW_END[name].search(html, at)
            end = close.start() if close else len(html)
            if end > at:
                yield TEXT, unescape(html[at:end]) if name in _REFERENCES_IN_RAW else html[at:end]
            at = text = end


def read_html(html: str | None) -> tuple[str | None, list | None]:
    """Plain-Python helper: ``(text, hrefs)`` of one page (None for None)."""
    if html is None:
        return None, None
    chunks: list[str] = []
    hrefs: list[str | None] = []
    removed: list[str] = []  # open elements that are left out, innermost last
    open_now: Counter = Counter()

    def close(name: str) -> None:
        """Close the innermost such element and all inside it (every element is closed once)."""
        gone = None
        while gone != name:
            gone = removed.pop()
            open_now[gone] -= 1

    for event in scan(html):
        if event[0] == TEXT:
            if not removed:
                chunks.append(event[1])
        elif event[0] == END:
            if open_now[event[1]]:
                close(event[1])
        else:
            _, name, attributes, closes = event
            if name == "a":
                hrefs.append(next((v for k, v in attributes if k == "href"), None))
            while name in _BODY_START and open_now["head"]:
                close("head")
            if not closes and name not in _VOID and (name in _REMOVED or any(k == "document" for k, _ in attributes)):
                removed.append(name)
                open_now[name] += 1
    return " ".join(" ".join(chunks).split()).replace("\x00", ""), hrefs


@F.arrow_udf(PARSED_HTML_TYPE)
def _parse_html_udf(html: pa.Array) -> pa.Array:
    texts, hrefs = [], []
    for h in html:
        t, links = read_html(h.as_py())
        texts.append(t)
        hrefs.append(links)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(hrefs, pa.list_(pa.string()))], names=["text", "hrefs"])


def parse_html(col) -> Column:
    """STRUCT<text STRING, hrefs ARRAY<STRING>> for an HTML column."""
    c = F.col(col) if isinstance(col, str) else col
    return _parse_html_udf(c)
