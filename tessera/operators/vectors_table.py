"""Vectors of document chunks, and what must still be embedded in a space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..runtime import ship


def chunk_vectors(docs: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(url_id, ordinal, values): one vector for each chunk."""
    ship(docs.sparkSession)
    flat = docs.select("url_id", F.inline("chunks"))
    return flat.select("url_id", "ordinal", embed(tokens(F.col("text"))).alias("values"))


def re_embed(docs: DataFrame, have: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Chunk vectors of the documents that have none in a space yet (url_id), from their stored text."""
    return chunk_vectors(docs.join(have.select("url_id").distinct(), "url_id", "left_anti"), embed)
