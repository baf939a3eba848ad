"""Native text functions: white space, tokens, chunks, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_WORDS = 256
SNIPPET_CHARS = 200


def normalize_whitespace(text: Column) -> Column:
    """Each run of Unicode white space becomes one space; none at either end."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and numbers."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def words(text: Column) -> Column:
    return F.filter(F.split(normalize_whitespace(text), " "), lambda w: w != "")


def chunks(text: Column, size: int = CHUNK_WORDS) -> Column:
    """Groups of ``size`` words joined by one space, numbered from 0; no words, no chunks."""
    ws = words(text)
    starts = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / size).cast("int")))
    cut = F.transform(starts, lambda i: F.struct(i.cast("int").alias("ordinal"), F.array_join(F.slice(ws, i * size + 1, size), " ").alias("text")))
    return F.coalesce(cut, F.array().cast("array<struct<ordinal:int,text:string>>"))


def truncate(text: Column, limit: int = SNIPPET_CHARS) -> Column:
    """At most ``limit`` characters, back to the last space among them, and an ellipsis if anything was cut."""
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), r" [^ ]*$", ""), F.lit("…")))


def snippet(description: Column, visible: Column) -> Column:
    """The page's own description if it has one, else its visible text."""
    own = trim_unicode(description)
    return truncate(F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(visible))


def body_of(chunk_column: Column) -> Column:
    """The text that the keyword index sees: all chunks, one a line."""
    return F.array_join(F.transform(chunk_column, lambda c: c["text"]), "\n")


def host_label(url: Column) -> Column:
    """A host for display, without a leading www."""
    return F.regexp_replace(F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), url), r"^www\.", "")


def highlight_terms(text: Column, query: Column) -> Column:
    """The text cut at terms of the query of two or more characters: an array of (part, hit)."""
    terms = F.filter(F.split(F.lower(trim_unicode(query)), r"\s+"), lambda t: F.char_length(t) >= 2)
    quoted = F.array_join(F.transform(terms, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    pattern = F.when(F.size(terms) > 0, F.concat(F.lit("(?i)"), quoted))
    parts = F.when(pattern.isNotNull(), F.filter(F.split(F.regexp_replace(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit("\u0001$1\u0001")), "\u0001"), lambda p: p != "")).otherwise(F.array(text))
    return F.transform(parts, lambda p: F.struct(p.alias("part"), F.array_contains(terms, F.lower(p)).alias("hit")))


def format_int(n: Column) -> Column:
    """A number rounded half up, with commas."""
    return F.format_number(F.floor(n + 0.5), 0)


def format_storage(megabytes: Column) -> Column:
    """Megabytes without decimals, or from 1024 on gigabytes with one."""
    return F.when(megabytes >= 1024, F.concat(F.format_string("%.1f", megabytes / 1024), F.lit(" GB"))).otherwise(F.concat(F.format_string("%.0f", megabytes.cast("double")), F.lit(" MB")))


def format_uptime(seconds: Column) -> Column:
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    return F.when(hours > 0, F.format_string("%dh %dm", hours, minutes)).otherwise(F.format_string("%dm", minutes))
