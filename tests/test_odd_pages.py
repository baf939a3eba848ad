"""Queries over pages with what larger tables have: URLs of several pages, and references that were cut."""

import os

import pytest
from oracle import TABLES, assert_same

from tessera import catalogue
from tessera.functions.html import page_record


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """The smallest tables, in which six pages share two URLs, titles and headings end in the midst of a reference, and three pages are long."""
    folder = tmp_path_factory.mktemp("odd")
    for t in set(TABLES) - {"pages"}:
        os.symlink(f"{sf}/{t}.parquet", folder / f"{t}.parquet")
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    pages["url"] = [f"https://twice.example.org/{i // 3}" if i < 6 else u for i, u in enumerate(pages["url"])]
    for k, end in enumerate(("&amp", "&am", "&quot;x&amp;lt;", "&")):
        html = pages.loc[k + 10, "html"]
        pages.loc[k + 10, "html"] = html.replace("</title>", f" {end}</title>").replace("</h1>", f" {end}</h1>")
    for k, size, letter in ((12, 65_400, "é"), (24, 65_519, "x"), (36, 65_520, "x")):  # a mark after more bytes than characters; one that starts in the window, and one that doesn't
        row = pages["page_id"] == k
        html = pages.loc[row, "html"].item()
        pages.loc[row, "html"] = html.replace("</body>", letter * (size - len(html)) + "</body>")
    assert pages["url"].duplicated().sum() == 4 and pages["html"].str.contains("&amp</title>", regex=False).any()
    pages.to_parquet(folder / "pages.parquet", index=False)
    return str(folder)


def test_page_search(spark, odd):
    assert_same(spark, odd, catalogue.QUERIES["page_search"], catalogue.ORACLE_SQL["page_search"])


def test_page_titles(spark, odd):
    assert_same(spark, odd, catalogue.QUERIES["page_titles"], catalogue.ORACLE_SQL["page_titles"])


def test_references():
    html = "<title>a&quot; &amp;&lt; &amp;lt; &copy; x&amp</title><body><a href='/p?a=1&amp;b=2'>y&amp</a> &eacute"
    title, _, text, _, found, _ = page_record("https://e.com", html)
    assert (title, text, found) == ('a" &< &lt; © x&', "y& é", ["https://e.com/p?a=1&b=2"])
    title, _, text, _, found, _ = page_record("https://e.com", html, ("lt", "gt", "amp"))
    assert (title, text, found) == ("a&quot; &< &lt; &copy; x&amp", "y&amp &eacute", ["https://e.com/p?a=1&b=2"])


def test_page_visible_text(spark, odd):
    assert_same(spark, odd, catalogue.QUERIES["page_visible_text"], catalogue.ORACLE_SQL["page_visible_text"])


def test_sniff_pages(spark, odd):
    assert_same(spark, odd, catalogue.QUERIES["sniff_pages"], catalogue.ORACLE_SQL["sniff_pages"])
    found = {r["page_id"]: r["may_have_retail"] for r in catalogue.QUERIES["sniff_pages"](spark, odd).collect()}
    assert [found[k] for k in (12, 24, 36)] == [True, True, False]


def test_web_observation_rows(spark, odd):
    assert_same(spark, odd, catalogue.QUERIES["web_observation_rows"], catalogue.ORACLE_SQL["web_observation_rows"])
