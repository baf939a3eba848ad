import json

import pytest

from tessera.operators.adapters import MAX_NODES, Adapter, Expr, Manifest, ManifestError, load_dir
from tessera.operators.extract import Registry
from tessera.operators.retail import of_page
from tessera.schemas import FETCHED_PAGE

MANIFESTS = {m.name: m for m in load_dir()}


def ld(value):
    return f'<html><script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script></html>'


def brief(rows):
    return [(r["sku"], r["price_minor"], r["currency"], r["availability"], r["quantity"]) for r in rows]


def test_built_in_extraction():
    lamp = {"@type": "Product", "sku": "lamp-7", "offers": {"price": " 1234.5 ", "priceCurrency": "CHF", "availability": "http://schema.org/SoldOut", "inventoryLevel": {"value": 0}}}
    assert brief(of_page("https://Shop.Test:443/l", ld(lamp))) == [("lamp-7", 123450, "CHF", "out_of_stock", 0)]
    assert of_page("https://Shop.Test:443/l", ld(lamp))[0]["store"] == "shop.test"
    # two products, the first inside of the second; offers with and without a price
    inner = {"@type": "Product", "mpn": "in", "offers": [{"price": 0, "priceCurrency": "BRL", "availability": "LimitedAvailability"}, {"price": "free"}]}
    outer = {"@graph": [{"@type": "Offer", "price": 3}, {"@type": ["Vehicle", "Product"], "sku": "out", "offers": {"price": 7.005, "priceCurrency": "SEK"}, "isRelatedTo": inner}]}
    assert brief(of_page("https://e.com/p", ld(outer))) == [("out", 701, "SEK", "unknown", None), ("in", 0, "BRL", "low_stock", None), ("in", None, None, "unknown", None)]
    assert brief(of_page("https://e.com/p", ld({"@type": "Product", "offers": {"sku": "by-offer", "inventoryLevel": {"value": "7"}}}))) == [("by-offer", None, None, "unknown", None)]
    assert of_page("https://e.com/p", ld({"@type": "Product", "sku": "no offers"})) == []
    og = '<meta property="og:price:amount" content="0.9"><meta property="og:price:currency" content="pln"><meta property="product:availability" content="Sold out">'
    assert brief(of_page("https://e.com/p?q=1", og)) == [("https://e.com/p?q=1", 90, "pln", "out_of_stock", None)]
    assert brief(of_page("https://e.com/p", og + ld(lamp))) == [("lamp-7", 123450, "CHF", "out_of_stock", 0)]
    # a block that is no JSON doesn't hide the next one
    assert brief(of_page("https://e.com/p", ld("{broken") + ld(lamp)))[0][0] == "lamp-7"
    assert of_page("https://e.com/p", ld("[1, 2")) == [] and of_page("https://e.com/p", "<p>x</p>") == []


def pages(spark, *rows):
    return spark.createDataFrame([(u, 200, c, b if isinstance(b, bytes) else b.encode(), 9) for u, c, b in rows], FETCHED_PAGE)


def got(adapter, df):
    return [(r["store"], r["sku"], r["availability"], r["quantity"], r["price_minor"], r["currency"]) for r in adapter.extract(df).orderBy("sku").collect()]


def test_shopify(spark):
    body = {"id": 77, "variants": [{"id": 501, "sku": "blue-xl", "available": False, "inventory_quantity": -2, "price": 0}, {"id": 502, "sku": "\t", "available": True, "price": 88_000_000_000}, {"id": 503, "sku": "red", "available": None, "inventory_quantity": 41, "price": "0730"}]}
    a = Adapter(MANIFESTS["shopify-products-json"])
    df = pages(spark, ("https://s.com/products/x.js", "application/json", json.dumps(body)), ("https://s.com/products/x", "application/json", json.dumps(body)), ("https://s.com/products/y.js", "text/html", json.dumps(body)), ("https://s.com/products/bad.js", None, "{nope"))
    assert got(a, df) == [("s.com", "502", "in_stock", None, 88_000_000_000, None), ("s.com", "blue-xl", "out_of_stock", None, 0, None), ("s.com", "red", "unknown", 41, 730, None)]
    assert [r["url"] for r in a.rejects(df).collect()] == ["https://s.com/products/bad.js"]
    many = json.dumps({"variants": [{"id": i} for i in range(MAX_NODES + 9)]})
    assert a.extract(pages(spark, ("https://s.com/products/m.js", None, many))).count() == MAX_NODES
    assert a.extract(pages(spark, ("https://s.com/products/m.js", None, '{"variants": null}'), ("https://s.com/products/n.js", None, "{}"))).count() == 0


def test_generic(spark):
    a = Adapter(MANIFESTS["generic-jsonld"])
    offer = lambda **o: ld({"@type": "Product", "productID": "P", "offers": o})
    words = {"https://schema.org/InStock": "in_stock", "InStock": "unknown", "http://schema.org/InStock": "unknown", "https://schema.org/BackOrder": "out_of_stock", "https://schema.org/PreOrder": "unknown", "https://schema.org/LimitedAvailability": "low_stock"}
    for word, meaning in words.items():
        assert got(a, pages(spark, ("https://E.com/p", "text/html", offer(availability=word, price="1", priceCurrency="USD")))) == [("e.com", "P", meaning, None, 100, "USD")]
    for code, value in (("USD", 30560), ("JPY", 306), ("BHD", 305596)):
        assert got(a, pages(spark, ("https://e.com/p", "text/html", offer(price="305.596", priceCurrency=code))))[0][4] == value
    many = ld({"@type": "Product", "sku": "S", "offers": [{"price": "1"}]})
    assert got(a, pages(spark, ("https://e.com/p", None, many))) == [("e.com", "S", "unknown", None, None, None)]
    none = ld({"@type": "Thing", "note": "Product"}).replace('"Product"', '"Product"')
    assert a.extract(pages(spark, ("https://e.com/p", None, none))).count() == 0 and a.rejects(pages(spark, ("https://e.com/p", None, none))).count() == 1


def test_woocommerce(spark):
    a = Adapter(MANIFESTS["woocommerce-store-api"])
    url = "https://w.com/wp-json/wc/store/v1/products?sku=A"
    item = lambda **x: {"id": 4, "sku": "A", "is_in_stock": True, "stock_quantity": 2, "prices": {"price": "640", "currency_code": "NOK", "currency_minor_unit": 2}} | x
    run = lambda *items: got(a, pages(spark, (url, "application/json", json.dumps(items))))
    assert run(item()) == [("w.com", "A", "in_stock", 2, 640, "NOK")]
    assert run(item(stock_quantity=None, prices={"price": "90210", "currency_code": "TND", "currency_minor_unit": 3})) == [("w.com", "A", "in_stock", None, 90210, "TND")]
    assert run() == [] and len(run(item(), item(sku="B"))) == 2
    assert run(item(stock_quantity=2.0, prices={"price": "7"})) == [("w.com", "A", "in_stock", None, None, None)]


MINIMAL = """
[adapter]
name = "n"
version = 1
extractor_kind = "retail"
method = "json_endpoint"
[match]
url_pattern = "https://{s}/x"
[fetch]
endpoint = "https://{s}/x"
format = "json"
[fields]
store = "url:{s}"
sku = "json:$.a.b"
availability = "const:none"
"""


def test_manifests():
    assert list(MANIFESTS) == ["generic-jsonld", "shopify-products-json", "woocommerce-store-api"]
    assert Manifest.parse(MINIMAL).fields["sku"] == Expr("json", ("a", "b"))
    swaps = [
        ("version = 1", "version = 2"), ('extractor_kind = "retail"', 'extractor_kind = "x"'), ('url_pattern = "https://{s}/x"', ""), ('url_pattern = "https://{s}/x"', 'url_pattern = "https://{s"'), ('endpoint = "https://{s}/x"', 'endpoint = "https://{s}/y"'),
        ('format = "json"', 'format = "html"'), ('format = "json"', 'format = "json"\nembedded = "jsonld:P"'), ('format = "json"', 'format = "html"\nembedded = "microdata:P"'), ("url:{s}\"", "url:{t}\""), ('availability = "const:none"', 'availability = "const:none"\nprice_minor = "json:$.p"'),
        ('availability = "const:none"', 'availability = "const:none"\nprice_minor = "json:$.p"\nprice_representation = "minor_int_with_exponent"'), ('availability = "const:none"', ""), ('availability = "const:none"', 'availability = "const:none"\ncolour = "const:x"'),
        ('sku = "json:$.a.b"', 'sku = "json:$.a..b"'), ('sku = "json:$.a.b"', 'sku = "xpath:/a"'), ('sku = "json:$.a.b"', 'sku = "const:"'), ('sku = "json:$.a.b"', 'sku = "url:{}"'), ("[fields]", "[fields"), ("[fields]", "[other]\nx = 1\n[fields]"), ('method = "json_endpoint"', 'method = "guess"'),
    ]
    for old, new in swaps:
        assert old in MINIMAL
        with pytest.raises(ManifestError):
            Manifest.parse(MINIMAL.replace(old, new))


def test_all_that_apply_run(spark):
    html = ld({"@type": "Product", "sku": "S", "offers": {"price": "1", "priceCurrency": "USD"}})
    registry = Registry.with_defaults(list(MANIFESTS.values()))
    df = pages(spark, ("https://e.com/p", "text/html", html))
    assert [(r["seq"], r["kind"]) for r in registry.applicable(df).orderBy("seq").collect()] == [(0, "web"), (1, "retail"), (2, "retail")]
    assert [r["seq"] for r in registry.observations(df).orderBy("seq").collect()] == [1, 2]
    assert registry.web_docs(df).count() == 1 and registry.rejects(pages(spark, ("bad url", "text/html", "<p>"))).count() == 1
