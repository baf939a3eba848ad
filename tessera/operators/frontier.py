"""The table of known URLs: subscribing, discovering, what is due, and who owns it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import url_id
from ..functions.urls import canonicalize, owns
from ..schemas import URL_ENTRY
from ..sources.tables import merge


def entries(urls: DataFrame, url: str = "url", make_id=url_id) -> DataFrame:
    """New rows, one for each different canonical URL; unusable URLs are dropped."""
    canonical = urls.select(canonicalize(F.col(url)).alias("url")).where("url is not null").distinct()
    return canonical.select(
        "url", make_id(F.col("url")).alias("id"), F.lit(None).cast("long").alias("last_crawled"), F.lit(None).cast("binary").alias("content_hash"),
        F.create_map().cast("map<string,long>").alias("last_embedded"), F.array().cast("array<string>").alias("applied"),
    )


def newest_lists(lists: DataFrame) -> DataFrame:
    """Of each list only its highest version, so that an old one can't come back."""
    best = F.max_by(F.struct(*(c for c in lists.columns if c != "id")), F.struct("version", "updated_at")).alias("x")
    return lists.groupBy("id").agg(best).select("id", "x.*")


def all_owned(url_id_column: Column) -> Column:
    return F.lit(True)


def modulo(nodes: int, index: int):
    """Ownership by id modulo the number of nodes."""
    owns(F.lit(None).cast("binary"), nodes, index)  # bad arguments fail now
    return lambda column: owns(column, nodes, index)


def owners(ids: DataFrame, nodes: int, copies: int = 1) -> DataFrame:
    """One row for each id and node that holds a copy: the owner and the next ones."""
    from ..functions.urls import owner

    return ids.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("node", (owner(F.col("id"), nodes) + F.col("copy")) % nodes)


class Frontier:
    """Operations on a frontier table; each gives a new table and changes nothing."""

    def __init__(self, table: DataFrame, owned=all_owned, make_id=url_id):
        """``make_id`` gives the id of a canonical URL; it must be the one that the table's ids were made with."""
        self.table, self.owned, self.make_id = table, owned, make_id

    @classmethod
    def empty(cls, spark: SparkSession, owned=all_owned, make_id=url_id) -> Frontier:
        return cls(spark.createDataFrame([], URL_ENTRY), owned, make_id)

    def _with(self, table: DataFrame) -> Frontier:
        return Frontier(table, self.owned, self.make_id)

    def get(self, ids: DataFrame) -> DataFrame:
        return self.table.join(ids.select("id"), "id", "left_semi")

    def put(self, rows: DataFrame) -> Frontier:
        """Replace or add rows by id; of rows with one id the one crawled last stays."""
        return self._with(merge(self.table, rows.select(*self.table.columns), "id", ["last_crawled"]))

    record = put

    def discover(self, urls: DataFrame, url: str = "url") -> Frontier:
        """Add the URLs that aren't known; known ones keep their state."""
        new = entries(urls, url, self.make_id).join(self.table.select("id"), "id", "left_anti")
        return self._with(self.table.unionByName(new))

    def subscribe(self, lists: DataFrame) -> Frontier:
        return self.discover(lists.select(F.explode("urls").alias("url")))

    def due(self, now: int, limit: int) -> DataFrame:
        """Owned rows, never crawled ones first, then those that waited longest, by id among equals; the first ``limit``."""
        age = F.when(F.col("last_crawled").isNotNull(), F.greatest(F.lit(now) - F.col("last_crawled"), F.lit(0)))
        return self.table.where(self.owned(F.col("id"))).orderBy(age.desc_nulls_first(), "id").limit(limit)

    def scan(self) -> DataFrame:
        """All rows by id."""
        return self.table.orderBy("id")

    def unchanged(self, fetched: DataFrame) -> DataFrame:
        """Fetched rows (id, content_hash, ...) whose content is what was seen last."""
        known = self.table.where("content_hash is not null").select("id", "content_hash")
        return fetched.join(known, ["id", "content_hash"], "left_semi")

    def to_embed(self, space: str) -> DataFrame:
        """Rows that were crawled since they were last embedded in a space."""
        last = F.try_element_at("last_embedded", F.lit(space))
        return self.table.where(F.col("last_crawled").isNotNull() & (last.isNull() | (last < F.col("last_crawled"))))
