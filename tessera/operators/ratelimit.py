"""Waiting times of requests to one host, natively over a log of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import stable


def waits(requests: DataFrame, floor: int, host: str = "host", now: str = "now", extra: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """Adds wait_secs: how long after ``now`` the request may go, given the one before it to the same host.

    The delay is the larger of ``floor`` and the host's own; what counts is the earlier request's
    ``now``, not when it really went. The first request to a host needn't wait. Requests are dealt out in
    ranges by host and time, so that a host with very many fills several; the last time of each range
    (one row for each host and range) is carried into the next.
    """
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    delay = F.greatest(F.lit(floor), F.coalesce(extra, F.lit(0))) if extra is not None else F.lit(floor)
    marked = requests.withColumn("__delay", delay)
    dealt = stable(marked.repartitionByRange(parts, host, now, *(order or [])).withColumn("__range", F.spark_partition_id()))
    lasts = dealt.groupBy(host, "__range").agg(F.max(now).alias("__last"))
    carried = lasts.withColumn("__far", F.max("__last").over(Window.partitionBy(host).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
    near = F.lag(now).over(Window.partitionBy(host, "__range").orderBy(now, *(order or [])))
    rows = dealt.withColumn("__near", near).join(carried, [host, "__range"])
    before = F.coalesce("__near", "__far")
    return rows.withColumn("wait_secs", F.greatest(F.coalesce(before + F.col("__delay") - F.col(now), F.lit(0)), F.lit(0))).select(*requests.columns, "wait_secs")
