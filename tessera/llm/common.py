"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import zipfile
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_llm_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tessera-")) / f"{PACKAGE.name}_llm_pkg.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(x for kind in ("py", "toml") for x in PACKAGE.rglob(f"*.{kind}")):
            z.write(p, p.relative_to(PACKAGE.parent).as_posix())
    sc.addPyFile(str(path))
    sc._tessera_llm_shipped = True


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
    """Cut the lineage with a reliable checkpoint in the folder that the cluster shares, ``spark.checkpoint.dir``."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    kept = df.checkpoint(eager=True)._jdf
    # a checkpoint inherits the size estimate of its plan, a product over joins whose digits double in
    # each round of an iteration; its rows as a new relation start anew
    rows = kept.queryExecution().toRdd()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, kept.schema(), False), df.sparkSession)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A materialised table of narrow rows, marked to be broadcast if it has at most so many rows; larger ones are joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def attach_by_key(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, sizes: DataFrame | None = None) -> DataFrame:
    """Join every row to the one row of its group without gathering a large group in one task.

    ``groups`` has one row per ``key``; it, or else ``sizes`` with the columns ``key`` and ``size``,
    should be materialised. A group is large if it has over half of an even task's share of all rows,
    so at most twice as many groups are large as there are shuffle partitions; only their keys are
    broadcast. The rows of a large group are dealt out by ``spread`` over as many join keys as it has
    such halves, and the group's row is repeated for each of them. The other groups are joined under
    salt 0. It is an inner join: rows without a group go.
    """
    sizes = groups if sizes is None else sizes
    total = sizes.agg(F.sum(size)).first()[0] or 0
    limit = max(100, total // (2 * shuffle_parts(rows.sparkSession)))
    hot = sizes.where(F.col(size) > limit).select(F.col(key).alias("__hot"), F.ceil(F.col(size) / limit).alias("__salts"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    dealt = dealt.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salts")), F.lit(0)).cast("long")).drop("__hot", "__salts")
    last = F.when(F.col(size) > limit, F.ceil(F.col(size) / limit) - 1).otherwise(F.lit(0).cast("long"))
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return dealt.join(copies, [key, "__salt"], "inner").drop("__salt")


def keyed(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """``row`` and the columns ``names`` (old to new): row is the same for the same row in every job.

    Rows of Parquet files (selected, renamed or filtered, but nothing else) have such a number already:
    the hash of the file's path and the place in the file, however the files are split. Rows of any other
    plan get a number that is stored with them in the shared checkpoint folder, since a second run of
    the plan may number them in another way (for example after an executor was lost).
    """
    columns = [F.col(f"`{old}`").alias(new) for old, new in names.items()]
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    if plan.getClass().getSimpleName() == "LogicalRelation" and plan.toString().rstrip().endswith(" parquet"):
        return docs.select(F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias("row"), *columns)
    return stable(docs.select(F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place")).alias("row"), *columns))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the text 'null'."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("null"))) % n


def text_slices(column: pa.Array, chars: int = 1_500_000) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of rows with about so many bytes, and their texts; only one range's texts are made at a time. A null is an empty text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + chars, side="right")))
        yield start, end, [t or "" for t in column.slice(start, end - start).to_pylist()]
        start = end


_models: dict[Hashable, Any] = {}


def give_back() -> None:
    """Return freed memory of this worker to the machine; workers stay for the next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def worker_model(key: Hashable, make: Callable[[], Any]) -> Any:
    """A Python worker's one loaded model: kept from task to task, given up for the next one."""
    if key not in _models:
        _models.clear()
        give_back()
        _models[key] = make()
    give_back()  # also what the last task and the making of the model left
    return _models[key]
