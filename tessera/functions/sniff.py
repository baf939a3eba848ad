"""Cheap native tests of a fetched page, to be applied before any parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HTML_WINDOW = 512
MARKUP_WINDOW = 65_536
# Substrings that make retail markup likely.
RETAIL_MARKS = ("ld+json", "og:price", "product:price", "product:availability")


def head(body: Column, size: int) -> Column:
    """The first bytes of a body as text; bytes that aren't UTF-8 become other characters."""
    return F.decode(F.substring(body, 1, size), "ISO-8859-1")


def byte_for_each(text: Column) -> Column:
    """A text with one byte for each character, ``?`` for those that aren't ASCII: the windows of these tests then count characters."""
    return F.encode(F.regexp_replace(text, r"[^\x00-\x7F]", "?"), "ISO-8859-1")


def looks_like_html(content_type: Column, body: Column) -> Column:
    declared = F.trim(F.coalesce(content_type, F.lit("")))
    start = F.lower(head(body, HTML_WINDOW))
    sniffed = F.contains(start, F.lit("<html")) | F.contains(start, F.lit("<!doctype"))
    return F.when(declared != "", F.contains(F.lower(declared), F.lit("html"))).otherwise(F.coalesce(sniffed, F.lit(False)))


def may_have_retail(content_type: Column, body: Column, window: int = MARKUP_WINDOW) -> Column:
    """HTML with one of the retail marks in its first ``window`` bytes, in any case."""
    text = F.lower(head(body, window))
    return looks_like_html(content_type, body) & F.exists(F.array(*map(F.lit, RETAIL_MARKS)), lambda m: F.contains(text, m))


def has_all(body: Column, marks: list[str]) -> Column:
    """All of these substrings near the start, in this case."""
    text = head(body, MARKUP_WINDOW)
    out = F.lit(True)
    for m in marks:
        out = out & F.contains(text, F.decode(F.encode(F.lit(m), "utf-8"), "ISO-8859-1"))
    return out


def content_type_ok(content_type: Column, body: Column, expected: str, body_format: str) -> Column:
    """The declared media type, if any, is the expected one, and the body looks like its format."""
    media = lambda c: F.lower(F.trim(F.split_part(c, F.lit(";"), F.lit(1))))
    declared = F.coalesce(media(content_type) == expected.split(";")[0].strip().lower(), F.lit(True))
    if body_format == "json":
        shape = F.coalesce(head(body, MARKUP_WINDOW).rlike(r"^[ \t\n\f\r]*[{\[]"), F.lit(False))
    else:
        shape = looks_like_html(content_type, body)
    return declared & shape


def body_within(body: Column, limit: int) -> Column:
    """A body of exactly the limit is fine; a longer one is an error, never cut."""
    return F.coalesce(F.octet_length(body) <= limit, F.lit(True))
