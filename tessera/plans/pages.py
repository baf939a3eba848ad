"""From fetched pages to the tables of the index, as one batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_embed, source_hash
from ..functions.text import body_of, tokens
from ..functions.urls import canonicalize
from ..operators.extract import Registry, Web, indexed_docs
from ..operators.frontier import Frontier
from ..operators.graph import Graph
from ..operators.search import lengths, postings
from ..operators.vectors_table import chunk_vectors
from ..runtime import ship, stable
from ..sources.tables import last_of


@dataclass
class IndexTables:
    web_docs: DataFrame
    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame
    vectors: DataFrame
    graph: Graph
    frontier: Frontier
    rejects: DataFrame

    def write(self, path: str) -> None:
        for name in ("docs", "postings", "lengths", "vectors", "rejects"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self.frontier.table.write.mode("overwrite").parquet(f"{path}/frontier")
        self.graph.save(f"{path}/graph")


def build(pages: DataFrame, frontier: Frontier, now: int, space_dim: int = 64, hash_body=source_hash) -> IndexTables:
    """Extract, index, embed, link and record pages. Pages whose content is what was seen last are skipped.

    Of a URL that was fetched several times the last fetch counts. Every page's markup is read once: what
    was read, and the ids and hashes, are stored, and all tables are made from that.
    """
    ship(pages.sparkSession)
    keyed = pages.withColumn("id", frontier.make_id(canonicalize(F.col("url")))).withColumn("content_hash", hash_body(F.col("body")))
    marks = stable(keyed.select("url", "id", "content_hash", "fetched_at"))
    known = stable(frontier.unchanged(marks).select("id").distinct())
    last = stable(last_of(marks.where("id is not null").join(known, "id", "left_anti"), "id", ["fetched_at"]))
    web = Web()
    read = pages.join(last.select("url", "fetched_at").distinct(), ["url", "fetched_at"], "left_semi").dropDuplicates(["url"])
    docs = stable(web.extract(read, hash_body))
    indexed = indexed_docs(docs, last.select("url", F.col("id").alias("url_id")), now)
    fields = indexed.select("url_id", "title", body_of(F.col("chunks")).alias("body"))
    found = docs.select(F.explode("discovered").alias("url")).unionByName(marks.select("url"))
    seen = frontier.discover(found)
    crawled = last.select("id", F.col("content_hash").alias("new_hash"), F.lit(now).cast("long").alias("now"))
    state = seen.table.join(crawled, "id", "left")
    recorded = state.select("url", "id", F.coalesce("now", "last_crawled").alias("last_crawled"), F.coalesce("new_hash", "content_hash").alias("content_hash"), "last_embedded", "applied")
    recorded = Frontier(stable(recorded), frontier.owned, frontier.make_id)
    unusable = pages.join(marks.where("id is null").select("url").distinct(), "url", "left_semi")
    return IndexTables(docs, indexed, postings(fields), lengths(fields), chunk_vectors(indexed, hash_embed(space_dim)), Graph.of_pages(docs), recorded, Registry([web]).rejects(unusable))


def page_terms(docs: DataFrame) -> DataFrame:
    """(url_id, terms): the different tokens of each document."""
    return docs.select("url_id", F.array_distinct(tokens(body_of(F.col("chunks")))).alias("terms"))
