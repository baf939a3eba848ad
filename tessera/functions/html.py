"""Reading markup in Arrow batches: title, visible text, metadata, links and embedded JSON-LD."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import parse, resolve

# Tags whose text isn't part of a page's visible text.
BOILERPLATE = frozenset(["script", "style", "noscript", "template", "nav", "header", "footer", "aside", "svg", "iframe", "object", "embed", "noembed"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
#: A start tag of the key closes an open element of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "a": {"a"}}
SPACES = re.compile(r"\s+")
PAGE_FIELDS = ("title", "description", "text", "links", "discovered", "error")
PAGE = "title string, description string, text string, links array<struct<to_url:string,anchor:string,rel:string>>, discovered array<string>, error string"


def squeeze(text: str) -> str:
    return SPACES.sub(" ", text).strip()


class Reader(HTMLParser):
    """One pass over a page; collects what all extractors need."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hidden = 0
        self.in_body = self.saw_body = False
        self.body_text: list[str] = []
        self.all_text: list[str] = []
        self.titles: list[list[str]] = []
        self.meta: list[dict[str, str | None]] = []
        self.anchors: list[tuple[str, str | None, list[str]]] = []
        self.json_ld: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a: dict[str, str | None] = {}
        for k, v in attrs:
            a.setdefault(k, v)
        while self.open and self.open[-1] in CLOSES.get(tag, ()):
            self.handle_endtag(self.open[-1])
        if tag == "body":
            self.in_body = self.saw_body = True
        elif tag == "meta":
            self.meta.append(a)
        elif tag == "title" and "svg" not in self.open:
            self.titles.append([])
        elif tag == "a" and a.get("href") is not None:
            self.anchors.append((a["href"], a.get("rel"), []))
        elif tag == "script" and a.get("type") == "application/ld+json":
            self.json_ld.append([])
        if tag not in VOID:
            self.open.append(tag)
            self.hidden += tag in BOILERPLATE

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and "svg" in self.open:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            self.hidden -= last in BOILERPLATE
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        last = self.open[-1] if self.open else ""
        if last == "title" and self.titles:
            self.titles[-1].append(data)
        if last == "script" and self.json_ld:
            self.json_ld[-1].append(data)
        if "a" in self.open and self.anchors:
            self.anchors[-1][2].append(data)
        if not self.hidden:
            (self.body_text if self.in_body else self.all_text).append(data)

    def meta_value(self, key: str) -> str | None:
        """The first non-empty content of a meta tag with that name or property."""
        for a in self.meta:
            if key in (a.get("name"), a.get("property")) and (a.get("content") or "").strip():
                return a["content"].strip()
        return None

    def title(self) -> str | None:
        first = squeeze("".join(self.titles[0])) if self.titles else ""
        return first or self.meta_value("og:title")

    def visible_text(self) -> str:
        return squeeze(" ".join(self.body_text if self.saw_body else [*self.all_text, *self.body_text]))

    def json_ld_values(self) -> list:
        """The values of all blocks that are valid JSON; numbers keep their digits as ``JsonNumber``."""
        out = []
        for block in self.json_ld:
            try:
                out.append(load_json("".join(block).strip()))
            except ValueError:
                continue
        return out


class JsonNumber(str):
    """A number of a JSON text, as written there."""


def load_json(text: str):
    """JSON with numbers kept as text and NaN and Infinity refused."""

    def refuse(name: str):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, parse_float=lambda s: JsonNumber(_float_text(s)), parse_int=JsonNumber, parse_constant=refuse)


def _float_text(s: str) -> str:
    """A fractional number's shortest text; one beyond 1e16 or with an exponent keeps it."""
    value = float(s)
    if value in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return repr(value)


def read(body: bytes | str, references: tuple[str, ...] | None = None) -> Reader:
    """Read a page. Character references are decoded as HTML does, or only those named in ``references``, each with its semicolon."""
    r = Reader()
    text = body if isinstance(body, str) else bytes(body).decode("utf-8", "replace")
    r.feed(text if references is None else re.sub(rf"&(?!(?:{'|'.join(references)});)", "&amp;", text))
    r.close()
    return r


def typed_nodes(value, want: str) -> list[dict]:
    """All objects whose @type is, or has, that name: in document order, also inside of one another."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            kind = v.get("@type")
            if isinstance(kind, str) and not isinstance(kind, JsonNumber) and kind == want or isinstance(kind, list) and want in kind:
                out.append(v)
            todo += reversed(list(v.values()))
        elif isinstance(v, list):
            todo += reversed(v)
    return out


def links(reader: Reader, base: str) -> tuple[list[dict], list[str]]:
    """All links resolved against the page's URL, with anchor text; and the different http(s) ones in order."""
    out, found = [], {}
    for href, rel, text in reader.anchors:
        href = href.strip()
        if not href or href.startswith(("#", "javascript:")):
            continue
        to = resolve(base, href)
        if to is None:
            continue
        out.append({"to_url": to, "anchor": squeeze("".join(text)), "rel": rel})
        if to.startswith(("http:", "https:")):
            found.setdefault(to)
    return out, list(found)


def page_record(url: str, body: bytes | str | None, references: tuple[str, ...] | None = None) -> tuple:
    if parse(url) is None:
        return None, None, None, None, None, "page url is not a valid absolute url"
    r = read(body if body is not None else b"", references)
    out, found = links(r, url)
    return r.title(), r.meta_value("description"), r.visible_text(), out, found, None


def page(url: Column, body: Column, references: tuple[str, ...] | None = None) -> Column:
    """Title, description, visible text, links and discovered URLs of a page, or an error; for ``references`` see ``read``."""

    def records(url: pd.Series, body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_record(u, b, references) for u, b in zip(url, body, strict=True)], columns=PAGE_FIELDS)

    return F.pandas_udf(records, PAGE)(url, body)
