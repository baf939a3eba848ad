"""Extractors over fetched pages, and the registry that runs every one that applies."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import source_hash
from ..functions.html import page
from ..functions.sniff import looks_like_html, may_have_retail
from ..functions.text import chunks, snippet
from ..runtime import ship
from . import retail
from .adapters import Adapter, Manifest


class Extractor(Protocol):
    """A source of facts: a cheap native test, rows, and the pages that it can't read."""

    kind: str

    def applies(self) -> Column: ...

    def extract(self, pages: DataFrame) -> DataFrame: ...

    def rejects(self, pages: DataFrame) -> DataFrame: ...


class Web:
    """Title, snippet, text chunks and links of HTML pages."""

    kind = "web"

    def applies(self) -> Column:
        return looks_like_html(F.col("content_type"), F.col("body"))

    def _read(self, pages: DataFrame) -> DataFrame:
        ship(pages.sparkSession)
        return pages.where(self.applies()).withColumn("p", page(F.col("url"), F.col("body")))

    def extract(self, pages: DataFrame, hash_body=source_hash, keep: tuple[str, ...] = ()) -> DataFrame:
        """Columns of the pages in ``keep`` stay."""
        good = self._read(pages).where("p.error is null")
        return good.select(*keep, "url", "p.title", snippet(F.col("p.description"), F.col("p.text")).alias("snippet"), chunks(F.col("p.text")).alias("chunks"), "p.links", "p.discovered", hash_body(F.col("body")).alias("source_hash"))

    def rejects(self, pages: DataFrame) -> DataFrame:
        return self._read(pages).where("p.error is not null").select("url", F.lit(self.kind).alias("extractor"), F.col("p.error").alias("reason"))


class Retail:
    """Observations from product markup."""

    kind = "retail"

    def applies(self) -> Column:
        return may_have_retail(F.col("content_type"), F.col("body"))

    def extract(self, pages: DataFrame) -> DataFrame:
        return retail.extract(pages)

    def rejects(self, pages: DataFrame) -> DataFrame:
        return pages.limit(0).select("url", F.lit(self.kind).alias("extractor"), F.lit("").alias("reason"))


class Registry:
    """Extractors in the order of registration; each page goes to all that apply, and none stops another."""

    def __init__(self, extractors: list[Extractor] | None = None):
        self.extractors: list[Extractor] = list(extractors or [])

    @classmethod
    def with_defaults(cls, manifests: list[Manifest] = ()) -> Registry:
        return cls([Web(), Retail(), *(Adapter(m) for m in manifests)])

    def register(self, extractor: Extractor) -> None:
        self.extractors.append(extractor)

    def kinds(self) -> list[str]:
        return [e.kind for e in self.extractors]

    def applicable(self, pages: DataFrame) -> DataFrame:
        """(url, seq, kind) of every page and extractor that applies, from one scan."""
        tests = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(e.kind).alias("kind"), F.coalesce(e.applies(), F.lit(False)).alias("ok")) for i, e in enumerate(self.extractors)))
        found = pages.select("url", F.explode(F.filter(tests, lambda t: t["ok"])).alias("t")).select("url", "t.seq", "t.kind")
        for i, e in enumerate(self.extractors):
            if isinstance(e, Adapter) and e.manifest.url_pattern is not None:
                found = found.where((F.col("seq") != i) | e.manifest.url_pattern.captures(F.col("url")).isNotNull())
        return found

    def web_docs(self, pages: DataFrame) -> DataFrame | None:
        return self._union([e.extract(pages) for e in self.extractors if e.kind == "web"])

    def observations(self, pages: DataFrame) -> DataFrame | None:
        """All observations with seq, the place of their extractor, so that equally late votes keep its order."""
        return self._union([e.extract(pages).withColumn("seq", F.lit(i).cast("long")) for i, e in enumerate(self.extractors) if e.kind == "retail"])

    def rejects(self, pages: DataFrame) -> DataFrame | None:
        return self._union([e.rejects(pages) for e in self.extractors])

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame | None:
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out


def indexed_docs(web_docs: DataFrame, url_ids: DataFrame, now: int) -> DataFrame:
    """Web documents as the index keeps them; ``url_ids`` has (url, url_id). The hash stays, links go."""
    return web_docs.join(url_ids, "url").select("url", "url_id", "title", "snippet", "chunks", F.lit(now).cast("long").alias("indexed_at"), "source_hash")


def web_observations(web_docs: DataFrame, observer: Column, observed_at: Column, seq: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    return web_docs.select(*keep, observer.alias("observer"), seq.cast("long").alias("seq"), "url", "source_hash", observed_at.cast("long").alias("observed_at"))
