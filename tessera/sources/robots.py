"""robots.txt: which paths an agent may fetch, and how long it must wait."""

from __future__ import annotations

import math
import re
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType


def groups(text: str) -> list[tuple[list[str], list[tuple[bool, str]], float | None]]:
    """(agents, rules, delay) of each group; a rule is (allow, path)."""
    out: list[tuple[list[str], list[tuple[bool, str]], float | None]] = []
    agents: list[str] = []
    fresh = False
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not fresh:
                agents = []
                out.append((agents, [], None))
            agents.append(value.lower())
            fresh = True
        elif out:
            fresh = False
            if key in ("allow", "disallow"):
                if value:
                    out[-1][1].append((key == "allow", value))
            elif key == "crawl-delay":
                try:
                    delay = float(value)
                except ValueError:
                    continue
                if math.isfinite(delay) and delay >= 0:
                    out[-1] = (*out[-1][:2], delay)
    return out


def _mine(text: str, agent: str) -> list[tuple[list[tuple[bool, str]], float | None]]:
    """The groups that name the agent's product, else those for all."""
    product = re.split(r"[/\s]", agent.strip().lower())[0]
    every = groups(text)
    named = [(r, d) for a, r, d in every if any(x != "*" and x and product.startswith(x.split("/")[0]) for x in a)]
    return named or [(r, d) for a, r, d in every if "*" in a]


def _pattern(rule: str) -> re.Pattern:
    end = rule.endswith("$")
    parts = (rule[:-1] if end else rule).split("*")
    return re.compile(".*".join(re.escape(quote(unquote(p), "/%?=&:@!$'()+,;~-._")) for p in parts) + ("$" if end else ""), re.S)


def _text(body: bytes | None) -> str | None:
    """The file as text, or none if it isn't one: then nothing is forbidden."""
    if body is None:
        return None
    try:
        return bytes(body).decode("utf-8-sig")
    except UnicodeDecodeError:
        return None


def is_allowed(body: bytes | None, agent: str, url: str) -> bool:
    """Whether the agent may fetch the URL. The longest rule that matches decides, Allow among equals."""
    text = _text(body)
    if text is None:
        return True
    u = urlsplit(url)
    path = quote(unquote(u.path or "/"), "/%?=&:@!$'()+,;~-._") + (f"?{u.query}" if u.query else "")
    best = (-1, True)
    for rules, _ in _mine(text, agent):
        for allow, rule in rules:
            if _pattern(rule).match(path):
                best = max(best, (len(rule), allow))
    return best[1]


def crawl_delay_secs(body: bytes | None, agent: str) -> int | None:
    """The agent's Crawl-Delay in whole seconds, rounded up."""
    text = _text(body)
    delays = [d for _, d in _mine(text, agent) if d is not None] if text is not None else []
    return math.ceil(delays[0]) if delays else None


def allowed(body: Column, agent: str, url: Column) -> Column:
    def run(bodies: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([is_allowed(b, agent, u) for b, u in zip(bodies, urls, strict=True)])

    run.__annotations__ = {"bodies": pd.Series, "urls": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, BooleanType())(body, url)


def delay(body: Column, agent: str) -> Column:
    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series([crawl_delay_secs(b, agent) for b in bodies], dtype="Int64")

    run.__annotations__ = {"bodies": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, LongType())(body)


def with_robots(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url", host: str = "host") -> DataFrame:
    """Adds allowed and crawl_delay from a table (host, body) of robots files; a host without one allows all."""
    joined = urls.join(robots.select(F.col("host").alias("__host"), F.col("body").alias("__robots")), F.col(host) == F.col("__host"), "left")
    known = F.col("__robots").isNotNull()
    return joined.withColumns({"allowed": F.when(known, allowed(F.col("__robots"), agent, F.col(url))).otherwise(F.lit(True)), "crawl_delay": F.when(known, delay(F.col("__robots"), agent))}).drop("__host", "__robots")
