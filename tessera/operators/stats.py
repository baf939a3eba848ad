"""Counts for a dashboard, and the simple search that it shows without an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rollup(docs: DataFrame, postings: DataFrame, edges: DataFrame, vectors: DataFrame, lists: DataFrame, nodes: DataFrame, body_bytes: str = "bytes") -> DataFrame:
    """One row of totals; each part is a count of its own table and they are joined as single rows."""
    parts = [
        docs.agg(F.count("*").alias("docs"), (F.sum(body_bytes) / 1e6).alias("megabytes")),
        postings.agg(F.count("*").alias("postings")),
        edges.agg(F.count("*").alias("edges")),
        vectors.agg(F.count_distinct("space").alias("spaces")),
        lists.agg(F.count("*").alias("lists")),
        nodes.agg(F.count("*").alias("peers")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def overlap_bonus(query: str, title: Column, snippet: Column, url: Column) -> Column:
    """3 for each word of the query, of two bytes or more, that is a part of title, snippet or URL."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")), F.coalesce(url, F.lit(""))))
    out = F.lit(0.0)
    for term in query.lower().split():
        if len(term.encode()) >= 2:
            out = out + F.when(F.contains(hay, F.lit(term)), 3.0).otherwise(0.0)
    return out


def simple_search(docs: DataFrame, query: str, base: str = "base_score", limit: int = 8) -> DataFrame:
    """Top hits by base score and overlap: only matching rows, or all if none matches. Ranks fall as 0.9 / n."""
    scored = docs.withColumn("bonus", overlap_bonus(query.strip(), F.col("title"), F.col("snippet"), F.col("url")))
    scored = scored.withColumn("score", F.col(base) + F.col("bonus"))
    some = scored.agg(F.max(F.col("bonus") > 0).alias("any"))
    kept = scored.crossJoin(F.broadcast(some)).where(F.col("any").isNull() | ~F.col("any") | (F.col("bonus") > 0)).orderBy(F.desc("score"), "url").limit(limit)
    return kept.select("url", "title", "snippet", "score", (0.9 / F.row_number().over(Window.orderBy(F.desc("score"), "url"))).alias("rank"))
