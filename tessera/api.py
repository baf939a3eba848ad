"""What a desktop client asks for: search, the node's status, and totals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import body_of
from .operators.extract import Registry
from .operators.graph import Graph
from .operators.search import Index, postings
from .operators.stats import rollup
from .schemas import VISIBILITY


@dataclass
class Client:
    """A thin face of the tables of one node."""

    node_id: str
    index: Index
    graph: Graph
    lists: DataFrame
    peers: DataFrame
    registry: Registry = field(default_factory=Registry.with_defaults)
    started_at: int = 0

    def search(self, query: str, limit: int = 8, space: str | None = None) -> DataFrame:
        return self.index.search(query.strip(), limit, space)

    def node_status(self, now: int) -> dict:
        """Small facts of this node; lists are few and are named with their number of URLs."""
        lists = self.lists.select("id", "name", F.size("urls").alias("n")).orderBy("id").collect()
        return {
            "node_id": self.node_id, "online": True, "uptime_secs": max(0, now - self.started_at), "query_visibility": VISIBILITY[0],
            "extractors": self.registry.kinds(), "served_spaces": self.index.served_spaces(),
            "subscribed_lists": [{"id": r["id"], "label": r["name"], "url_count": r["n"]} for r in lists], "peers_connected": self.peers.count(),
        }

    def stats(self) -> DataFrame:
        """One row of totals over the node's tables."""
        docs = self.index.docs.withColumn("body", body_of(F.col("chunks"))).withColumn("bytes", F.octet_length("body"))
        spaces = None
        for name, vectors in self.index.vectors.items():
            part = vectors.select(F.lit(name).alias("space"))
            spaces = part if spaces is None else spaces.unionByName(part)
        spaces = spaces if spaces is not None else docs.limit(0).select(F.lit("").alias("space"))
        return rollup(docs, postings(docs), self.graph.edges, spaces, self.lists, self.peers)
