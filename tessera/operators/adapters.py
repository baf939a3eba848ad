"""Declarative adapters: TOML manifests that say how to read observations from JSON or embedded JSON-LD."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import JsonNumber, load_json, read, typed_nodes
from ..functions.price import REPRESENTATIONS, minor_units
from ..functions.sniff import content_type_ok, has_all
from ..functions.urls import TemplateError, UrlTemplate, host_text
from ..runtime import ship
from ..schemas import AVAILABILITY, OBSERVATION, RETAIL_METHOD

VERSION = 1
KIND = "retail"
IMPLICIT = ("host", "page_url")
MAX_NODES = 1024
BUILT_IN = Path(__file__).resolve().parent.parent / "manifests"
#: Sections of a manifest and, where they are fixed, their keys; required ones have a star.
SECTIONS = {
    "adapter": ("name*", "version*", "extractor_kind*", "method*"), "match": ("url_pattern", "content_type", "requires"),
    "fetch": ("endpoint*", "http_method", "format*", "embedded"), "iterate": ("path*",),
    "fields": ("store*", "sku*", "sku_fallback", "availability*", "quantity", "price_minor", "price_representation", "currency", "price_exponent"),
    "availability_map": None, "currency_exponents": None, "notes": None,
}


class ManifestError(ValueError):
    """A manifest that can't be used, with the reason."""


@dataclass(frozen=True)
class Expr:
    """Where a field comes from: ``url`` (a capture), ``json`` (a path of keys), ``const`` (a text) or ``none``."""

    kind: str
    value: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str) -> Expr:
        kind, colon, rest = text.partition(":") if isinstance(text, str) else ("", "", "")
        if colon and kind == "url" and len(rest) > 2 and rest[0] == "{" and rest[-1] == "}":
            return cls("url", (rest[1:-1],))
        if colon and kind == "json" and rest.startswith("$.") and all(rest[2:].split(".")):
            return cls("json", tuple(rest[2:].split(".")))
        if colon and kind == "const" and rest:
            return cls("none") if rest == "none" else cls("const", (rest,))
        raise ManifestError(f"{text!r} is not url:{{capture}}, json:$.path, const:TEXT or const:none")

    def value_in(self, node, captures: dict[str, str]):
        if self.kind == "url":
            return captures.get(self.value[0])
        if self.kind == "const":
            return self.value[0]
        if self.kind == "none":
            return None
        for key in self.value:
            node = node.get(key) if isinstance(node, dict) else None
        return node


def text_of(value) -> str | None:
    """A string, number or boolean as text, not trimmed; a blank one is null, and so is an array or object."""
    text = scalar(value)
    return text if text is not None and text.strip() else None


def scalar(value) -> str | None:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, str) else None


@dataclass
class Manifest:
    """A checked manifest; ``fields`` holds expressions."""

    name: str
    method: str
    url_pattern: UrlTemplate | None
    content_type: str | None
    requires: list[str]
    body_format: str
    embedded: str | None
    iterate: str | None
    fields: dict[str, Expr]
    representation: str | None
    availability_map: dict[str, str]
    currency_exponents: dict[str, int] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Manifest:
        try:
            raw = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise ManifestError(f"not valid TOML: {e}") from e
        for section in raw.keys() - SECTIONS.keys():
            raise ManifestError(f"unknown section {section!r}")
        for section, keys in SECTIONS.items():
            got = raw.get(section, {})
            if not isinstance(got, dict):
                raise ManifestError(f"{section} must be a table")
            if keys is not None and (section in raw or section in ("adapter", "match", "fetch", "fields")):
                for k in got.keys() - {k.rstrip("*") for k in keys}:
                    raise ManifestError(f"unknown key {section}.{k}")
                for k in keys:
                    if k[-1] == "*" and k[:-1] not in got:
                        raise ManifestError(f"{section}.{k[:-1]} is missing")
        a, match, fetch, f = raw["adapter"], raw.get("match", {}), raw["fetch"], dict(raw["fields"])
        if a["version"] != VERSION:
            raise ManifestError(f"version {a['version']} isn't supported, only {VERSION}")
        if a["extractor_kind"] != KIND:
            raise ManifestError(f"no interpreter for extractor_kind {a['extractor_kind']!r}")
        if a["method"] not in RETAIL_METHOD:
            raise ManifestError(f"method must be one of {RETAIL_METHOD}")
        if "url_pattern" not in match and "content_type" not in match:
            raise ManifestError("match needs a url_pattern or a content_type, or it claims every page")
        try:
            template = UrlTemplate(match["url_pattern"]) if "url_pattern" in match else None
        except TemplateError as e:
            raise ManifestError(f"url_pattern: {e}") from e
        if fetch["endpoint"] not in ("{page_url}", match.get("url_pattern")):
            raise ManifestError(f"endpoint {fetch['endpoint']!r} is another page than the one that was fetched")
        if fetch["format"] not in ("json", "html"):
            raise ManifestError("format must be json or html")
        embedded = fetch.get("embedded")
        if (fetch["format"] == "html") != (embedded is not None):
            raise ManifestError("embedded is needed for html and must not be there for json")
        if embedded is not None and (not embedded.startswith("jsonld:") or embedded == "jsonld:"):
            raise ManifestError(f"embedded {embedded!r} isn't jsonld:<type>")
        representation = f.pop("price_representation", None)
        fields = {k: Expr.parse(v) for k, v in f.items()}
        known = {*IMPLICIT, *(template.names if template else ())}
        for e in fields.values():
            if e.kind == "url" and e.value[0] not in known:
                raise ManifestError(f"no capture named {e.value[0]!r}")
        if representation is not None and representation not in REPRESENTATIONS:
            raise ManifestError(f"price_representation must be one of {REPRESENTATIONS}")
        if "price_minor" in fields and representation is None:
            raise ManifestError("price_minor needs a price_representation")
        if "price_minor" in fields and representation == REPRESENTATIONS[2] and "price_exponent" not in fields:
            raise ManifestError("this price_representation needs a price_exponent")
        words = raw.get("availability_map", {})
        if set(words.values()) - set(AVAILABILITY):
            raise ManifestError(f"availability must be one of {AVAILABILITY}")
        return cls(a["name"], a["method"], template, match.get("content_type"), match.get("requires", []), fetch["format"], embedded and embedded[7:], raw.get("iterate", {}).get("path"), fields, representation, words, {k.upper(): v for k, v in raw.get("currency_exponents", {}).items()}, raw.get("notes", {}))

    def nodes(self, root) -> list:
        """What is iterated over: an array's elements, another value by itself, nothing for null."""
        if self.iterate is None:
            return [root]
        path = self.iterate.removesuffix("[]")
        target = root
        if path not in ("", "$"):
            for key in path.removeprefix("$.").split("."):
                target = target.get(key) if isinstance(target, dict) else None
        return target if isinstance(target, list) else [] if target is None else [target]

    def root(self, body: bytes):
        """The JSON to read from; raises ValueError if there is none."""
        if self.body_format == "json":
            return load_json(bytes(body).decode("utf-8"))
        for value in read(body).json_ld_values():
            if found := typed_nodes(value, self.embedded):
                return found[0]
        raise ValueError(f"no embedded JSON-LD node of type {self.embedded}")

    def read(self, url: str, body: bytes) -> tuple[list[dict], str | None]:
        """Raw fields of at most ``MAX_NODES`` nodes with a store and a sku, and an error if the body can't be read.

        Texts are as in the source; prices and availability are still to be normalised.
        """
        captures = (self.url_pattern.match(url) if self.url_pattern else None) or {}
        captures["page_url"] = url
        if (host := host_text(url)) is not None:
            captures["host"] = host
        try:
            root = self.root(body)
        except (ValueError, RecursionError) as e:
            return [], f"{self.name}: {e}"[:500]
        out = []
        for node in self.nodes(root)[:MAX_NODES]:
            get = lambda name: self.fields[name].value_in(node, captures) if name in self.fields else None  # noqa: B023, E731
            store = text_of(get("store"))
            sku = text_of(get("sku"))
            sku = sku if sku is not None else text_of(get("sku_fallback"))
            if store is None or sku is None:
                continue
            count, price, stated = get("quantity"), get("price_minor"), get("price_exponent")
            plain = isinstance(count, JsonNumber) and count.isdigit() and int(count) < 2**63
            digits = stated.strip() if isinstance(stated, str) else ""
            out.append({
                "store": store, "sku": sku, "availability": scalar(get("availability")), "quantity": int(count) if plain else None,
                "price": scalar(price) if isinstance(price, str) else None, "currency": text_of(get("currency")),
                "stated": int(digits) if digits.isdigit() and int(digits) < 2**31 else None,
            })
        return out, None


def load_dir(path: str | Path = BUILT_IN) -> list[Manifest]:
    """All manifests of a folder by file name; a bad one fails them all."""
    out = []
    for p in sorted(Path(path).glob("*.toml"), key=lambda p: p.name):
        try:
            out.append(Manifest.parse(p.read_text()))
        except ManifestError as e:
            raise ManifestError(f"{p.name}: {e}") from e
    return out


RAW = "struct<rows:array<struct<store:string,sku:string,availability:string,quantity:bigint,price:string,currency:string,stated:int>>,error:string>"


class Adapter:
    """One manifest over a table of pages: native tests first, then one Arrow pass, then native normalisation."""

    def __init__(self, manifest: Manifest):
        self.manifest, self.kind = manifest, KIND

    def applies(self) -> Column:
        m = self.manifest
        out = F.lit(True)
        if m.content_type is not None:
            out = out & content_type_ok(F.col("content_type"), F.col("body"), m.content_type, m.body_format)
        if m.requires:
            out = out & has_all(F.col("body"), m.requires)
        return out

    def selected(self, pages: DataFrame) -> DataFrame:
        m = self.manifest
        rows = pages.where(F.coalesce(self.applies(), F.lit(False)))
        return rows if m.url_pattern is None else rows.where(m.url_pattern.captures(F.col("url")).isNotNull())

    def raw(self, pages: DataFrame) -> DataFrame:
        ship(pages.sparkSession)
        m = self.manifest

        def run(url: pd.Series, body: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([m.read(u, b if b is not None else b"") for u, b in zip(url, body, strict=True)], columns=["rows", "error"])

        run.__annotations__ = {"url": pd.Series, "body": pd.Series, "return": pd.DataFrame}
        return self.selected(pages).select("url", "fetched_at", F.pandas_udf(run, RAW)("url", "body").alias("x"))

    def extract(self, pages: DataFrame) -> DataFrame:
        """url and the fields of an observation."""
        m = self.manifest
        rows = self.raw(pages).select("url", "fetched_at", F.explode("x.rows").alias("o"))
        words = [x for k, v in m.availability_map.items() for x in (F.lit(k), F.lit(v))]
        known = F.try_element_at(F.create_map(*words), F.col("o.availability")) if words else F.lit(None).cast("string")
        price = minor_units(F.col("o.price"), m.representation, F.col("o.currency"), m.currency_exponents, F.col("o.stated")) if m.representation else F.lit(None).cast("long")
        values = {"availability": F.coalesce(known, F.lit("unknown")), "price_minor": price, "method": F.lit(m.method), "observed_at": F.col("fetched_at")}
        names = [c.split()[0] for c in OBSERVATION.split(", ")]
        return rows.select("url", *(values.get(n, F.col(f"o.{n}")).alias(n) for n in names))

    def rejects(self, pages: DataFrame) -> DataFrame:
        return self.raw(pages).where("x.error is not null").select("url", F.lit(f"{KIND}:{self.manifest.name}").alias("extractor"), F.col("x.error").alias("reason"))
