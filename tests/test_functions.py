import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import hashing, price, text, urls, vectors
from tessera.functions.html import JsonNumber, load_json, page_record, read, typed_nodes
from tessera.functions.sniff import body_within, content_type_ok, has_all, looks_like_html, may_have_retail


def column(spark, rows, schema, expr):
    """The values of an expression, in the order of the rows."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").coalesce(1)
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_blake3_known_answers():
    assert hashing.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert hashing.blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    pattern = lambda n: bytes(i % 251 for i in range(n))  # noqa: E731  the published test inputs
    assert hashing.blake3(pattern(1)).hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert len({hashing.blake3(pattern(n)) for n in (1023, 1024, 1025, 2048, 2049, 5000)}) == 6


def test_fnv():
    def plain(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return h

    words = [b"", b"a", b"hello", "é日本".encode(), b"x" * 300]
    assert hashing.hashing.fnv1a(words).tolist() == [plain(w) for w in words]
    v = hashing.embed_tokens([["a", "b", "a"], []], 16)
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not v[1].any()
    with pytest.raises(ValueError):
        hashing.hash_embed(0)


def test_text(spark):
    t = F.col("t")
    odd = ["  a  b　\tc ", "", None]
    assert column(spark, [(x,) for x in odd], "t string", text.normalize_whitespace(t)) == ["a b c", "", None]
    words = " ".join(f"w{i}" for i in range(300))
    got = column(spark, [(words,), ("",), (None,), (" \n ",)], "t string", text.chunks(t))
    assert [[(c["ordinal"], len(c["text"].split())) for c in x] for x in got] == [[(0, 256), (1, 44)], [], [], []]
    long = "word " * 60
    got = column(spark, [(long.strip(),), ("x" * 250,), ("y" * 200,), ("short",)], "t string", text.truncate(t))
    assert got == [("word " * 40).strip() + "…", "x" * 200 + "…", "y" * 200, "short"]
    assert column(spark, [("Año-2 x_y É1",)], "t string", text.tokens(t)) == [["año", "2", "x", "y", "é1"]]
    assert column(spark, [(" d ", "v"), ("  ", "v"), (None, "v")], "a string, b string", text.snippet(F.col("a"), F.col("b"))) == ["d", "v", "v"]
    assert column(spark, [("https://www.Ex.com/a",)], "t string", text.host_label(t)) == ["ex.com"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://Example.COM/Path", "https://example.com/Path"), ("http://e.com:80/p", "http://e.com/p"), ("https://e.com:443", "https://e.com/"), ("http://e.com:8080/p", "http://e.com:8080/p"),
        ("https://e.com/x#frag", "https://e.com/x"), ("https://e.com/x?b=2&a=1", "https://e.com/x?b=2&a=1"), ("https://e.com/x/", "https://e.com/x/"), ("/relative", None), ("not a url", None), ("", None), (None, None),
        ("https://e.com/a/../b/./c", "https://e.com/b/c"), ("https://e.com?q", "https://e.com/?q"), ("ftp://e.com:21/f", "ftp://e.com/f"),
    ],
)
def test_canonical(raw, want):
    assert urls.canonical_text(raw) == want
    if want:
        assert urls.canonical_text(want) == want


def test_resolve_and_hosts():
    base = "https://e.com/blog/2024/post/"
    assert urls.resolve(base, "../sibling") == "https://e.com/blog/2024/sibling"
    assert urls.resolve(base, "deeper/page#x") == "https://e.com/blog/2024/post/deeper/page#x"
    assert urls.resolve(base, "//o.org/x") == "https://o.org/x"
    assert urls.host_key_text("http://E.com:8080/") == "e.com:8080" and urls.host_key_text("https://e.com:443/") == "e.com" and urls.host_key_text("mailto:a@b") is None


def test_templates():
    t = urls.UrlTemplate("https://{store}/products/{handle}.js")
    assert t.match("https://a.com/products/red-shoe.js") == {"store": "a.com", "handle": "red-shoe"}
    for bad in ("https://a.com/products/x.json", "https://a.com/products/.js", "https://a.com/products/a/b.js", "https://a.com/x", "https://a.com/products/x.js/y", None):
        assert t.match(bad) is None
    assert t.match("https://a.com/products/x.js#f") == {"store": "a.com", "handle": "x"}
    assert urls.UrlTemplate("https://{h}.js").match("https://a.js.js") is None  # only the first place is tried
    q = urls.UrlTemplate("https://{site}/p?sku={sku}&v=1")
    assert q.match("https://s/p?z=9&v=1&sku=A") == {"site": "s", "sku": "A"}
    assert q.match("https://s/p?sku=A") is None and q.match("https://s/p?sku=&v=1") is None and q.match("https://s/p?v=2&sku=A") is None
    for bad in ("https://{a", "https://{}", "https://{a}{b}", "https://x/?sku", "https://x/?sku={}"):
        with pytest.raises(urls.TemplateError):
            urls.UrlTemplate(bad)


def test_every_id_has_one_owner(spark):
    ids = spark.range(500).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("id"))
    n = F.lit(0)
    for i in range(5):
        n = n + urls.owns(F.col("id"), 5, i).cast("int")
    assert [r["n"] for r in ids.select(n.alias("n")).distinct().collect()] == [1]
    little = spark.createDataFrame([(bytes([7, 0, 0, 0, 0, 0, 0, 0] + [9] * 24),), (bytes([255] * 32),)], "id binary").select(urls.owner(F.col("id"), 5)).collect()
    assert [r[0] for r in little] == [2, (2**64 - 1) % 5]
    for bad in ((5, 5), (5, -1)):
        with pytest.raises(ValueError):
            urls.owns(F.col("id"), *bad)


def test_exact_prices(spark):
    table = {"JPY": 0, "KWD": 3}
    dec = price.minor_units(F.col("p"), "major_decimal", F.col("c"), table)
    cases = [("19.99", "USD", 1999), ("1200", "jpy", 1200), ("19.995", "KWD", 19995), ("5", None, 500), ("5.5", None, 550), ("19.999", None, 2000), ("19.994", None, 1999), ("-1.50", None, -150), (".5", None, 50), ("5.", None, 500), (" 7 ", None, 700), ("+3", None, 300),
             ("0.0049999", None, 0), ("2.675", None, 268), ("92233720368547758.07", None, 2**63 - 1), ("92233720368547758.08", None, None), ("99999999999999999999999999", None, None),
             (".", None, None), ("", None, None), ("R 1 299,00", None, None), ("$19.99", None, None), ("1,299.00", None, None), ("true", None, None), ("1e3", None, None), (None, None, None)]
    assert column(spark, [c[:2] for c in cases], "p string, c string", dec) == [c[2] for c in cases]
    whole = price.minor_units(F.col("p"), "minor_int", F.lit(None).cast("string"), table)
    assert column(spark, [("1999",), ("1999.5",), ("x",)], "p string", whole) == [1999, 2000, None]
    stated = price.minor_units(F.col("p"), "minor_int_with_exponent", F.col("c"), {"USD": 2, "JPY": 0, "KWD": 3}, F.col("e"))
    cases = [("1999", "USD", 2, 1999), ("120000", "JPY", 2, 1200), ("1999", "KWD", 2, 19990), ("1200", "XYZ", 0, 1200), ("2450", None, 2, 2450), ("1999", "USD", None, None), ("149", "JPY", 2, 1), ("150", "JPY", 2, 2), ("-150", "JPY", 2, -2)]
    assert column(spark, [c[:3] for c in cases], "p string, c string, e int", stated) == [c[3] for c in cases]
    with pytest.raises(ValueError):
        price.minor_units(F.col("p"), "other", F.col("c"), {})


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.decimals(-(10**9), 10**9, allow_nan=False, places=5), st.integers(0, 4)), min_size=1, max_size=40))
def test_scaled_agrees_with_decimal(spark, rows):
    got = column(spark, [(f"{d:f}", e) for d, e in rows], "p string, e int", price.scaled(F.col("p"), F.col("e")))
    assert got == [int((d * 10**e).quantize(Decimal(1), ROUND_HALF_UP)) for d, e in rows]


def test_approximate_prices(spark):
    cases = [("19.99", 1999), ("42.505", 4251), ("NaN", None), ("inf", None), ("x", None), ("1e2", 10000), (None, None)]
    assert column(spark, [c[:1] for c in cases], "p string", price.approximate_minor(F.col("p"))) == [c[1] for c in cases]


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0, 9.0], [1.0, 0.0])]
    got = column(spark, rows, "a array<float>, b array<float>", vectors.cosine_distance(a, b))
    assert [round(x, 6) for x in got] == [0, 1, 2, 1, 0]
    q = column(spark, [([1.0, -0.5, 0.0],), ([0.0, 0.0],)], "a array<float>", vectors.quantize_int8(a))
    assert [list(x["i8"]) for x in q] == [[127, -64, 0], [0, 0]] and math.isclose(q[0]["scale"], 1 / 127) and q[1]["scale"] == 1.0
    bits = column(spark, [([0.0, -1.0, 1.0] + [-1.0] * 6 + [2.0],)], "a array<float>", vectors.quantize_binary(a))
    assert bytes(bits[0]) == bytes([0b101, 0b10])
    assert column(spark, [(10, "binary"), (10, "int8"), (10, "f32")], "a int, b string", vectors.vector_bytes(a, b)) == [2, 10, 40]
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0])], "k int, values array<float>")
    assert {r["k"]: list(r["centroid"]) for r in vectors.centroids(df, "k").collect()} == {1: [2.0, 3.0], 2: [5.0, 5.0]}
    with pytest.raises(Exception, match="differ"):
        vectors.centroids(df.unionByName(spark.createDataFrame([(1, [1.0])], "k int, values array<float>")), "k").collect()
    assert [r["k"] for r in vectors.top_k(df.select(F.monotonically_increasing_id().alias("k"), "values"), [3.0, 4.0], 2, "k").collect()] is not None
    assert vectors.top_k(df, [1.0, 1.0], 0, "k").count() == 0


def test_sniffing(spark):
    c, b = F.col("c"), F.col("b")
    rows = [("text/HTML; x", b"{}"), ("application/json", b"<html>"), (None, b"<!DOCTYPE html>"), ("  ", b" <HTML"), (None, b" " * 600 + b"<html"), (None, b"{}"), (None, None)]
    assert column(spark, rows, "c string, b binary", looks_like_html(c, b)) == [True, False, True, True, False, False, False]
    assert column(spark, [("text/html", b"x LD+JSON"), ("text/html", b" " * 65_536 + b"ld+json"), ("text/plain", b"og:price")], "c string, b binary", may_have_retail(c, b)) == [True, False, False]
    assert column(spark, [(b"a Product",), (b"a product",)], "b binary", has_all(b, ["Product", "a"])) == [True, False]
    rows = [("application/json; q", b' \n{"a"'), (None, b"[1"), ("text/html", b"{"), ("application/json", b"<html")]
    assert column(spark, rows, "c string, b binary", content_type_ok(c, b, "application/json", "json")) == [True, True, False, False]
    assert column(spark, [(b"12345",), (b"123456",), (b"",)], "b binary", body_within(b, 5)) == [True, False, True]


def test_markup():
    html = """<!doctype html><html><head><title> A
      title </title><meta name="description" content=" about "><style>p{}</style></head><body><nav><a href="/n">Nav</a></nav><p>one<b>two</b></p><script>var x = "<p>no</p>"</script>
      <a href="#top">t</a><a href="javascript:void(0)">j</a><a href=" /real#f " rel="nofollow">Real <i>link</i></a><a href="/real#f">again</a><a href="mailto:x@y.z">m</a><footer>foot</footer></body></html>"""
    title, description, visible, found, discovered, error = page_record("https://e.com/p", html)
    assert (title, description, error) == ("A title", "about", None)
    assert visible == "one two t j Real link again m"
    assert [(x["to_url"], x["anchor"], x["rel"]) for x in found] == [("https://e.com/n", "Nav", None), ("https://e.com/real#f", "Real link", "nofollow"), ("https://e.com/real#f", "again", None), ("mailto:x@y.z", "m", None)]
    assert discovered == ["https://e.com/n", "https://e.com/real#f"]
    assert page_record("nope", html)[-1] is not None
    assert page_record("https://e.com", '<title> </title><meta property="og:title" content="og">')[0] == "og"
    r = read('<script type="application/ld+json">{"@type": "A", "x": [{"@type": ["B", "A"], "n": 1.50}]}</script><script type="application/ld+json">{bad</script>')
    assert [n.get("n") for n in typed_nodes(r.json_ld_values()[0], "A")] == [None, "1.5"] and len(r.json_ld_values()) == 1
    assert isinstance(load_json("7"), JsonNumber)
    with pytest.raises(ValueError):
        load_json("NaN")


def test_blake3_of_many():
    """Bodies hashed side by side give what each gives alone, for all lengths around blocks, chunks and trees; and published values."""
    bodies = [bytes(i % 251 for i in range(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3073, 5000, 8193, 31_744, 102_400)]
    blake3_many, blake3 = hashing.blake3_many, hashing.blake3
    assert blake3_many(bodies) == [blake3(b) for b in bodies] == blake3_many(bodies, at_once=3000)
    assert blake3(b"").hex().startswith("af1349b9f5f9a1a6a0404dea36dcc949") and blake3(bodies[6]).hex().startswith("42214739f095a406f3fc83deb889744a")
    assert blake3(bodies[13]).hex().startswith("62b6960e1a44bcc1eb1a611a8d6235b6") and blake3(bodies[14]).hex().startswith("bc3e3d41a1146b069abffad3c0d44860")


def test_fnv_of_long_tokens():
    """A token of a megabyte beside many short ones takes no memory of the product of both."""
    def plain(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return h

    words = [b"", b"a", b"foobar", b"x" * 1_000_000, *(str(k).encode() for k in range(3000)), b"a", b"y" * 300]
    assert hashing.fnv1a(words).tolist() == [plain(w) for w in words]
    assert hashing.fnv1a([]).tolist() == []
