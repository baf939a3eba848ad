"""Price and stock observations from the markup of product pages."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import JsonNumber, read, typed_nodes
from ..functions.sniff import may_have_retail
from ..functions.urls import host_text
from ..runtime import ship
from ..schemas import OBSERVATION

# What availability words mean, after their last slash, letters and digits only, in lower case.
MEANING = {
    "instock": "in_stock", "available": "in_stock", "onlineonly": "in_stock", "instoreonly": "in_stock",
    "outofstock": "out_of_stock", "soldout": "out_of_stock", "discontinued": "out_of_stock",
    "lowstock": "low_stock", "limitedavailability": "low_stock", "preorder": "low_stock", "backorder": "low_stock", "backordered": "low_stock", "presale": "low_stock",
}
MAX_QUANTITY = 2**63 - 1


def availability(text: Column) -> Column:
    """An availability word or schema URL as one of the four values."""
    token = F.lower(F.regexp_replace(F.element_at(F.split(text, "/"), -1), "[^A-Za-z0-9]", ""))
    table = F.create_map(*(x for k, v in MEANING.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, token), F.lit("unknown"))


def availability_text(text: str | None) -> str:
    return MEANING.get(re.sub("[^A-Za-z0-9]", "", text.rsplit("/", 1)[-1]).lower(), "unknown") if text is not None else "unknown"


def text_of(value) -> str | None:
    return value if isinstance(value, str) and not isinstance(value, JsonNumber) else None


def quantity_of(value) -> int | None:
    """A whole, non-negative JSON number; a text isn't one, nor is 7.0."""
    return int(value) if isinstance(value, JsonNumber) and value.isdigit() and int(value) <= MAX_QUANTITY else None


def cents(value) -> int | None:
    """Hundredths through a double, half away from zero; null for NaN and what doesn't fit."""
    if not isinstance(value, str):
        return None
    text = value.strip()
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        return None
    x = float(text) * 100
    out = math.floor(abs(x) + 0.5) if abs(x) < 2**52 else abs(x)
    return None if out == math.inf or out > MAX_QUANTITY else int(math.copysign(1, x) * out)


def of_product(product: dict, page_url: str) -> list[dict]:
    """One observation for each offer; the sku is the product's own, the offer's, or the page."""
    own = next((t for k in ("sku", "productID", "mpn") if (t := text_of(product.get(k))) is not None), None)
    offers = product.get("offers")
    out = []
    for offer in offers if isinstance(offers, list) else [offers]:
        if not isinstance(offer, dict):
            continue
        level = offer.get("inventoryLevel")
        sku = own if own is not None else text_of(offer.get("sku"))
        out.append({
            "sku": sku if sku is not None else page_url, "availability": availability_text(text_of(offer.get("availability"))),
            "quantity": quantity_of(level.get("value")) if isinstance(level, dict) else None,
            "price_minor": cents(offer.get("price")), "currency": text_of(offer.get("priceCurrency")),
        })
    return out


def of_page(url: str, body: bytes | str) -> list[dict]:
    """Observations of all JSON-LD products; without any, at most one of the page's own metadata."""
    r = read(body)
    out = [o for value in r.json_ld_values() for p in typed_nodes(value, "Product") for o in of_product(p, url)]
    if not out:
        first = lambda *keys: next((v for k in keys if (v := r.meta_value(k)) is not None), None)
        price, stock = first("og:price:amount", "product:price:amount"), first("product:availability", "og:availability")
        if price is not None or stock is not None:
            out = [{"sku": url, "availability": availability_text(stock), "quantity": None, "price_minor": cents(price), "currency": first("og:price:currency", "product:price:currency")}]
    store = host_text(url) or url
    return [{"store": store, **o, "method": "structured_data"} for o in out]


FOUND = "array<struct<store:string,sku:string,availability:string,quantity:bigint,price_minor:bigint,currency:string,method:string>>"


def _of_pages(url: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([of_page(u, b) for u, b in zip(url, body, strict=True)])


def extract(pages: DataFrame) -> DataFrame:
    """Observations (url and the fields of an observation) of the pages that may have retail markup."""
    ship(pages.sparkSession)

    likely = pages.where(may_have_retail(F.col("content_type"), F.col("body")))
    rows = likely.select("url", "fetched_at", F.explode(F.pandas_udf(_of_pages, FOUND)("url", "body")).alias("o"))
    names = [c.split()[0] for c in OBSERVATION.split(", ")]
    return rows.select("url", *(F.col("fetched_at").alias(n) if n == "observed_at" else F.col(f"o.{n}") for n in names))
