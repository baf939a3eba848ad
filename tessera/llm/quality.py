"""Quality scores: random Fourier features of document statistics, ridge regression and isotonic calibration."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, ship, stable, text_slices

N_STATISTICS = 20


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; all zero for a text without words."""
    words = (text or "").split()
    if not words:
        return [0.0] * N_STATISTICS
    n = len(words)
    chars = len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    per = np.bincount(raw, minlength=256)
    letters = int(per[65:91].sum() + per[97:123].sum() + per[192:].sum())
    upper, digits, space = int(per[65:91].sum()), int(per[48:58].sum()), int(per[32] + per[9:14].sum())
    symbols = int(per[33:48].sum() + per[58:65].sum() + per[91:97].sum() + per[123:127].sum())
    plain = int(per[44] + per[46])
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    again = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    odd_end = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(n), np.log1p(chars), lengths.mean(), lengths.std(), np.log1p(lengths.max()), distinct / n, pairs / max(1, n - 1), again / n, max(counts.values()) / n,
        letters / len(raw), upper / max(1, letters), digits / len(raw), space / len(raw), symbols / len(raw), (symbols - plain) / len(raw), odd_end / n,
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), len(zlib.compress(raw.tobytes(), 1)) / len(raw),
    ]


class Fourier:
    """Features whose inner products approximate a Gaussian kernel on standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, size: int, width: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.turns = rng.normal(0, 1 / width, (len(mean), size))
        self.phase = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.turns + self.phase), np.ones((len(x), 1))])


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nondecreasing fit by pooling neighbours: scores and values of the blocks' ends."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first, last
    for s, y in zip(score[order].tolist(), label[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += y
            blocks[-1][1] += 1
        else:
            blocks.append([y, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, count, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + count, blocks[-1][2], last]
    return np.array([x for b in blocks for x in (b[2], b[3])]), np.array([b[0] / b[1] for b in blocks for _ in range(2)])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)


def normal_equations(rows: DataFrame, fourier: Fourier, parts: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y over all rows (stats, y): one matrix from each of at most ``parts`` tasks."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(fourier.phase) + 1
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            x = fourier(matrix(batch.column("stats")))
            a += x.T @ x
            b += x.T @ batch.column("y").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["a", "b"])

    found = rows.select("stats", F.col("y").cast("double").alias("y")).repartition(parts).mapInArrow(add, "a binary, b binary").collect()
    size = len(fourier.phase) + 1
    return sum(np.frombuffer(bytes(r["a"])).reshape(size, size) for r in found), sum(np.frombuffer(bytes(r["b"])) for r in found)


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", features: int = 300, width: float = 4.0, ridge: float = 1e-3, max_rows: int = 200_000) -> DataFrame:
    """Score every whole text; higher means that label 1 is likelier.

    The statistics of all texts are made once and kept. Of the labelled rows where ``learn`` holds
    (``labels`` has the id and the label, 0 or 1), at most about ``max_rows`` are used, picked by a hash
    of the id. Three quarters fit the ridge weights of random Fourier features by normal equations
    summed in partitions; the rest calibrate the scores by isotonic regression.

    Returns the id, score (0 to 1) and raw_score. Defined cases: null and empty texts have zero
    statistics and a score like any other; a very long text is described whole; null labels are not
    learned from; of an id with several labels the mean counts; with fewer than 20 labelled rows every
    score is their share of 1 (0.5 if there are none); repeated rows each give a row; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t) for _, _, texts in text_slices(batch.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(stats, pa.list_(pa.float64()))], names=["id", "stats"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = stable(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(describe, f"id {kind}, stats array<double>"))
    known = labels.where(F.col(label_col).isNotNull() & learn).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)).alias("h"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.col("h") < int(max_rows / total * (1 << 30)))
    # one label for each id: the mean of its labels; an id that very many rows have is spread
    known = stable(known.groupBy("id").agg(F.avg("y").alias("y"), F.first("h").alias("h")))
    wanted = F.broadcast(known.select("id")) if total <= 2 * max_rows else known.select("id")
    some = stable(rows.join(wanted, "id"))
    sizes = stable(some.groupBy("id").agg(F.count("*").alias("n")))
    train = stable(attach_by_key(some, sizes.join(known, "id"), "id", "n", F.hash("stats"), sizes).drop("n"))
    size, share = train.agg(F.count("*"), F.avg("y")).first()
    if size < 20 or share in (0, 1):
        even = float(share) if size else 0.5
        return rows.select(F.col("id").alias(id_col), F.lit(even).alias("score"), F.lit(even).alias("raw_score"))
    moments = train.agg(*(f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(N_STATISTICS))).first()
    fourier = Fourier(np.array(moments[:N_STATISTICS]), np.array(moments[N_STATISTICS:]), features, width)
    a, b = normal_equations(train.where(F.col("h") % 4 != 0), fourier)
    weights = np.linalg.solve(a + ridge * max(1.0, np.trace(a) / len(a)) * np.eye(len(a)), b)

    def score(batches: Iterable[pa.RecordBatch], known_at=None, known_value=None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = fourier(matrix(batch.column("stats"))) @ weights
            value = raw if known_at is None else np.clip(np.interp(raw, known_at, known_value) + 1e-6 * np.tanh(raw - 0.5), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(value), pa.array(raw)], names=["id", "score", "raw_score"])

    schema = f"id {kind}, score double, raw_score double"
    held = train.where(F.col("h") % 4 == 0)
    pairs = held.select(F.col("y").alias("id"), "stats").mapInArrow(score, "id double, score double, raw_score double").select("raw_score", F.col("id").alias("y")).toPandas()
    at, value = isotonic(pairs["raw_score"].to_numpy(), pairs["y"].to_numpy(float)) if len(pairs) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def calibrated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return score(batches, at, value)

    return rows.mapInArrow(calibrated, schema).withColumnRenamed("id", id_col)
