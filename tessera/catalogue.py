"""All registered queries of the engine, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue_pages, catalogue_search, catalogue_streams, catalogue_votes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**catalogue_votes.QUERIES, **catalogue_pages.QUERIES, **catalogue_search.QUERIES, **catalogue_streams.QUERIES}
ORACLE_SQL: dict[str, str] = {**catalogue_votes.ORACLE_SQL, **catalogue_pages.ORACLE_SQL, **catalogue_search.ORACLE_SQL, **catalogue_streams.ORACLE_SQL}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to search results: extraction, chunks, postings, BM25."""
    return catalogue_search.page_search(spark, sf_dir)
