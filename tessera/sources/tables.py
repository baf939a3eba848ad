"""Tables as Parquet: reading, replacing, and merging by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def open_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, or an empty one with that schema if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def last_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last in the order of some columns (nulls first); among equals, by a hash of the row's plain columns."""
    plain = [c for c, kind in rows.dtypes if not kind.startswith("map") and "map<" not in kind]
    best = F.max_by(F.struct(*rows.columns), F.struct(*order, F.xxhash64(*plain).alias("__hash"))).alias("x")
    return rows.groupBy(F.col(key).alias("__key")).agg(best).select("x.*")


def merge(old: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """``new`` replaces rows of ``old`` with its keys and adds the rest; of repeated keys in it the last in ``order`` counts."""
    new = last_of(new, key, order or [])
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def pages_of(html: DataFrame, url: str = "url", body: str = "html", status: int = 200, content_type: str | None = "text/html", fetched_at: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """A table of texts as fetched pages; columns in ``keep`` stay."""
    return html.select(*keep, F.col(url).alias("url"), F.lit(status).alias("status"), F.lit(content_type).alias("content_type"), F.encode(F.col(body), "utf-8").alias("body"), F.lit(fetched_at).cast("long").alias("fetched_at"))


