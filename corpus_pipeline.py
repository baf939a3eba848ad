"""The corpus pipeline: each stage takes all rows its predecessor kept and is written as Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import bpe
from tessera.llm.common import crc_mod, shared_folder, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.language_id import UNKNOWN, language_id
from tessera.llm.near_dedup import drop_near_duplicates

#: A text that resembles a learned language needs 2 to 8 bits a symbol; letters of an unknown script need about 16.
MAX_BITS = 10.0
#: Below so many symbols (letters and gaps) a text is too short to tell an unknown script by its bits.
FEW_SYMBOLS = 8


def kept(docs: DataFrame, operator: Callable[[DataFrame, dict[str, str]], DataFrame], keep: Column) -> DataFrame:
    """The rows of ``docs`` that ``keep`` holds for in the operator's result, with their own columns.

    The operator gets the columns under other names (given by the second argument), so that none can
    be taken for one of its results.
    """
    names = {c: f"__doc{k}" for k, c in enumerate(docs.columns)}
    found = operator(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names)
    return found.where(keep).select(*(F.col(n).alias(c) for c, n in names.items()))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a learned language; texts without letters and in unknown scripts go.

    Null and empty texts go, as they have no letters; texts of a few symbols are only judged by having
    a language. Long texts are read whole, equal rows are judged alike, an empty table gives no rows,
    other columns stay as they are.
    """

    def find(rows: DataFrame, names: dict[str, str]) -> DataFrame:
        return language_id(rows, learn=crc_mod(F.col(names["doc_id"]), 5) != 0, id_col=names["doc_id"], text_col=names["text"], lang_col=names["lang"])

    known = (F.col("bits_per_symbol") <= MAX_BITS) | (F.col("n_symbols") < FEW_SYMBOLS)
    return kept(docs, find, (F.col("lang_pred") != UNKNOWN) & known)


def keep_first_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, the one with the least doc_id (a null one counts as largest; of repeated rows, one).

    A null text is an empty one; long texts are compared whole; an empty table gives no rows; other
    columns stay as they are.
    """
    return kept(docs, lambda rows, names: exact_dedup(rows, id_col=names["doc_id"], text_col=names["text"]), F.col("kept"))


def keep_one_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the row with the least doc_id (a null one counts as largest; of repeated rows, one).

    Rows without words are classes of their own; long texts are compared whole; an empty table gives no
    rows; other columns stay as they are.
    """
    return drop_near_duplicates(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of the benchmark.

    Null and empty texts have none and stay; long texts are searched whole; repeated rows are judged
    alike; an empty table or benchmark is allowed; other columns stay as they are.
    """

    def find(rows: DataFrame, names: dict[str, str]) -> DataFrame:
        return decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=names["doc_id"], text_col=names["text"], carry=rows.columns)

    return kept(docs, find, F.size("spans") == 0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns, with the token ids of the text, and whether decoding gives the text back.

    Null and empty texts have no tokens; long texts are encoded whole; repeated rows each give a row; an
    empty table gives none. Input columns named as one of the four new ones get the suffix `_in`.
    """
    new = ("n_tokens", "token_ids", "ids_sha256", "round_trip")
    names = {c: f"__doc{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    coded = bpe(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, text_col=names["text"])
    same = F.col("decoded") == F.encode(F.coalesce(names["text"], F.lit("")), "utf-8")
    free = {c: c if c not in new else f"{c}_in" for c in names}
    return coded.select(*(F.col(n).alias(free[c]) for c, n in names.items()), "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), same.alias("round_trip"))


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", keep_first_copy),
    ("near_dedup", keep_one_of_class),
    ("decontaminate", keep_clean),
    ("byte_bpe", encode),
]

#: SQL can express neither the language model nor BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the cluster's shared folder and read again.

    A stage's table is deleted when the next one is written; the last one stays, as the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, done = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done is not None:
            old = spark._jvm.org.apache.hadoop.fs.Path(done)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        done = path
    return docs
