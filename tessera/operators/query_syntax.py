"""The query language of keyword search: words, phrases, fields, signs, AND, OR, NOT and parentheses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"""\s*(?:(?P<open>\()|(?P<close>\))|(?P<sign>[+-])(?=[^\s)])|(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s()":]+)))""")


class BadQuery(ValueError):
    """The text isn't a query."""


@dataclass(frozen=True)
class Leaf:
    """Tokens that must follow one another, in one field or in any."""

    tokens: tuple[str, ...]
    field: str | None = None


@dataclass
class Group:
    """A document must have all of ``must`` and none of ``never``; without ``must`` it must have one of ``may``."""

    must: list = field(default_factory=list)
    may: list = field(default_factory=list)
    never: list = field(default_factory=list)


def words(text: str) -> list[str]:
    """Lower-case runs of letters and numbers."""
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def parse(text: str, fields: tuple[str, ...]) -> Group:
    """The query as a group. Upper-case AND, OR and NOT are operators, in lower case they are words.

    Words side by side may each match. `+x` and both sides of AND must match, `-x` and NOT x must not; AND
    binds closer than OR. A word of several tokens is a phrase. Unknown fields, unclosed quotes and
    parentheses, and operators without operand raise ``BadQuery``.
    """
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise BadQuery(text[at:])
        tokens.append(m)
        at = m.end()
    group, rest = _group(tokens, 0, fields)
    if rest != len(tokens):
        raise BadQuery("a parenthesis is closed but not opened")
    return group


def _group(tokens: list[re.Match], at: int, fields: tuple[str, ...]) -> tuple[Group, int]:
    """The group that begins at a token, and the place after it: a closing parenthesis or the end."""
    chains: list[list[tuple[str, object]]] = []  # operands joined by AND, each with its sign
    joined = True  # an operand is due
    operator = None
    while at < len(tokens) and not tokens[at]["close"]:
        word = None if tokens[at]["field"] else tokens[at]["word"]
        if word in ("AND", "OR"):
            if joined:
                raise BadQuery(f"{word} without a left side")
            operator, joined, at = word, True, at + 1
            continue
        sign = ""
        if word == "NOT":
            sign, at = "-", at + 1
        elif tokens[at]["sign"]:
            sign, at = tokens[at]["sign"], at + 1
        if at == len(tokens) or tokens[at]["close"]:
            raise BadQuery("an operand is missing")
        operand, at = _operand(tokens, at, fields)
        if operator == "AND":
            chains[-1].append((sign, operand))
        else:
            chains.append([(sign, operand)])
        operator, joined = None, False
    if operator is not None or not chains:
        raise BadQuery("an operand is missing")
    out = Group()
    for chain in chains:
        if len(chain) == 1:
            sign, operand = chain[0]
            {"": out.may, "+": out.must, "-": out.never}[sign].append(operand)
        else:
            both = Group()
            for sign, operand in chain:
                (both.never if sign == "-" else both.must).append(operand)
            out.may.append(both)
    return out, at


def _operand(tokens: list[re.Match], at: int, fields: tuple[str, ...]) -> tuple[object, int]:
    m = tokens[at]
    if m["open"]:
        group, at = _group(tokens, at + 1, fields)
        if at == len(tokens):
            raise BadQuery("a parenthesis is opened but not closed")
        return group, at + 1
    if m["sign"] or not m["field"] and m["word"] in ("AND", "OR", "NOT"):
        raise BadQuery("an operand is missing")
    if m["field"] and m["field"] not in fields:
        raise BadQuery(f"there is no field {m['field']}")
    value = m["phrase"] if m["phrase"] is not None else m["word"]
    return Leaf((value,) if m["field"] == "url" else tuple(words(value)), m["field"]), at + 1
