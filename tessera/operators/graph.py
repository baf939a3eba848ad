"""The link graph as an edge table (src, dst, pos); targets needn't be crawled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import number_rows, stable
from ..schemas import EDGE


class Graph:
    """Edges and the sources that were entered, which may have no edges."""

    def __init__(self, edges: DataFrame, sources: DataFrame):
        self.edges, self.sources = edges, sources

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], EDGE), spark.createDataFrame([], "src string"))

    @classmethod
    def of_pages(cls, docs: DataFrame) -> Graph:
        """All links of web documents in their order, duplicates kept."""
        edges = docs.select(F.col("url").alias("src"), F.posexplode("links").alias("pos", "link"))
        return cls(edges.select("src", F.col("link.to_url").alias("dst"), "pos"), docs.select(F.col("url").alias("src")).distinct())

    def set_edges(self, new: DataFrame, sources: DataFrame | None = None) -> Graph:
        """Replace the edges of the sources in ``new`` (src, dst, pos); duplicates stay."""
        given = new.select("src") if sources is None else sources.select("src")
        given = given.distinct()
        kept = self.edges.join(given, "src", "left_anti")
        return Graph(kept.unionByName(new.select("src", "dst", "pos")), self.sources.unionByName(given).distinct())

    def add_edges(self, new: DataFrame) -> Graph:
        """Append edges (src, dst) that aren't there; each once, after those there are."""
        fresh = new.select("src", "dst").distinct().join(self.edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
        last = self.edges.groupBy("src").agg(F.max("pos").alias("last"))
        numbered = number_rows(fresh, ["src"], [F.col("dst")], "k")
        placed = numbered.join(last, "src", "left").select("src", "dst", (F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("k")).cast("int").alias("pos"))
        return Graph(self.edges.unionByName(placed), self.sources.unionByName(fresh.select("src")).distinct())

    def neighbors(self, src: str) -> DataFrame:
        return self.edges.where(F.col("src") == src).orderBy("pos").select("dst")

    def node_count(self) -> int:
        """Sources, also those without edges; targets alone don't count."""
        return self.sources.count()

    def save(self, path: str) -> None:
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        self.sources.write.mode("overwrite").parquet(f"{path}/sources")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        return cls(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/sources"))


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 10, every: int = 5) -> DataFrame:
    """(node, rank) after some iterations of PageRank that restarts at the seeds (node).

    Edges count by how often they occur. Rank at nodes without edges returns to the seeds. The lineage
    is cut ``every`` few iterations; only (node, rank) moves between iterations, joined to the edges,
    which are kept in one place.
    """
    weight = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = stable(weight.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    seeds = stable(seeds.select("node").distinct())
    start = 1.0 / max(1, seeds.count())
    rank = seeds.withColumn("rank", F.lit(start))
    for i in range(iterations):
        sent = rank.join(links, rank.node == links.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        moved = sent.agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("moved"))
        back = seeds.crossJoin(F.broadcast(moved)).select("node", ((1 - F.col("moved") * damping) * start).alias("back"))
        rank = sent.join(back, "node", "full_outer").select("node", (damping * F.coalesce("got", F.lit(0.0)) + F.coalesce("back", F.lit(0.0))).alias("rank"))
        if (i + 1) % every == 0:
            rank = stable(rank)
    return rank


def min_pagerank(edges: DataFrame, seed_sets: list[DataFrame], **options) -> DataFrame:
    """(node, rank): the least personalised rank over several independent seed sets, null-free; unreached by one is 0."""
    ranks = [personalized_pagerank(edges, s, **options).withColumn("set", F.lit(i)) for i, s in enumerate(seed_sets)]
    every = ranks[0]
    for r in ranks[1:]:
        every = every.unionByName(r)
    return every.groupBy("node").agg(F.when(F.count("*") == len(seed_sets), F.min("rank")).otherwise(F.lit(0.0)).alias("rank"))


def link_degree(edges: DataFrame) -> DataFrame:
    """(url, out_degree, in_degree), each different edge once."""
    once = edges.select("src", "dst").distinct()
    out = once.select(F.col("src").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = once.select(F.col("dst").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("url").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
