"""What operators need from the session: shipping this package, and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tessera-")) / f"{PACKAGE.name}_pkg.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*")):
            if p.suffix in (".py", ".toml"):
                z.write(p, p.relative_to(PACKAGE.parent).as_posix())
    sc.addPyFile(str(path))
    sc._tessera_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine (tests) gets a folder of its own if that is unset; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_tessera_folder", None):
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc._tessera_folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    return sc._tessera_folder


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    kept = df.checkpoint(eager=True)._jdf
    # as a new relation: a checkpoint inherits its plan's size estimate, which grows with each round of an iteration
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), df.sparkSession)


def number_rows(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Gapless numbers from 0 in an order within each group ``by``, without gathering a group in one task.

    Rows are dealt out in ranges of that order; the counts of the ranges (one row for each group and
    range) give where a range's numbers start.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stable(rows.repartitionByRange(parts, *by, *order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    placed = dealt.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order)) - 1)
    return placed.join(starts, [*by, "__range"]).withColumn(name, (F.col("__from") + F.col("__k")).cast("long")).drop("__range", "__from", "__k")
