"""Removal of repeated passages, found by anchors at the positions of a difference cover."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, ship, text_slices, worker_model
from .text_hash import ODD, mix, run_hashes, word_hashes, words_of

#: Each difference modulo 13 is one between two of these, so that any two positions have a common distance to the next ones.
PERIOD, COVER = 13, (0, 1, 3, 9)
LAST = 2**63 - 1


class Flat:
    """The word hashes of some texts in one array, with each word's text, place and the words from there on."""

    def __init__(self, texts: list[str | None]):
        hashes = [word_hashes(words_of(t)) for t in texts]
        size = np.array([len(h) for h in hashes], np.int64)
        self.hashes = np.concatenate([*hashes, np.empty(0, np.uint64)])
        self.doc = np.repeat(np.arange(len(texts)), size)
        self.first = np.repeat(np.cumsum(size) - size, size)
        self.place = np.arange(len(self.hashes)) - self.first
        self.rest = np.repeat(size, size) - self.place

    def anchors(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the cover with at least ``run`` words from there, and the hashes of those runs."""
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.rest >= run))
        return at, run_hashes(self.hashes, run, at, seed=3)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(bucket[part[0]]), part


def repeated_anchors(docs: DataFrame, text: str, run: int, buckets: int, bits: int, chunk: int = 1_000_000) -> list[bytes]:
    """For each bucket a compressed bitmap of the anchors that occur at least twice; ``bits`` in all.

    A task sends each of its anchors once, as 32 bits within its bucket, so that a hot passage is one
    number from each task. Bits that clash only make more candidates.
    """

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            once, n = np.unique(np.concatenate(held), return_counts=True)
            rows = [(b, once[at].astype(np.uint32).tobytes(), once[at[n[at] > 1]].astype(np.uint32).tobytes()) for b, at in _by_bucket(_bucket(once, buckets))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "once", "more"])

        held, size = [], 0
        for batch in batches:
            for _, _, texts in text_slices(batch.column("text")):
                held.append(Flat(texts).anchors(run)[1])
                size += len(held[-1])
                if size >= chunk:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def gather(t: pa.Table) -> pa.Table:
        seen = np.sort(np.frombuffer(b"".join(t.column("once").to_pylist()), np.uint32))
        twice = np.concatenate([seen[1:][seen[1:] == seen[:-1]], np.frombuffer(b"".join(t.column("more").to_pylist()), np.uint32)])
        marks = np.zeros(bits // buckets, bool)
        marks[_mark(twice, bits // buckets)] = True
        return pa.table({"bucket": pa.array(t.column("bucket").to_pylist()[:1], pa.int32()), "bitmap": pa.array([zlib.compress(np.packbits(marks).tobytes(), 1)], pa.binary())})

    sent = docs.select(F.col(text).alias("text")).mapInArrow(send, "bucket int, once binary, more binary")
    found = sent.groupBy("bucket").applyInArrow(gather, "bucket int, bitmap binary").collect()
    empty = zlib.compress(bytes(-(-(bits // buckets) // 8)), 1)
    by = {r["bucket"]: bytes(r["bitmap"]) for r in found}
    return [by.get(b, empty) for b in range(buckets)]


def _mark(low: np.ndarray, width: int) -> np.ndarray:
    return (low.astype(np.uint64) * np.uint64(width) >> np.uint64(32)).astype(np.int64)


def repeated_starts(docs: DataFrame, files: np.ndarray, window: int, run: int, buckets: int, bitmaps: list[bytes], bits: int, chunk: int = 500_000) -> DataFrame:
    """(row, spans): what the windows that also start earlier cover, as pairs of int32 (end exclusive); one row for each row with any.

    ``docs`` has row, id and text; ``files`` are the numbers of its files in order, so that a row is one
    number here. Only windows with a repeated anchor in reach are hashed whole. A task keeps the earliest of equal
    windows and already knows that its others are repeated; so it sends each window once. What a bucket
    of windows finds goes back in one piece to each of as many buckets of rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmaps)
    width = bits // buckets  # a multiple of 8
    key = uuid.uuid4().hex
    shift = 40 if len(files) > 1 else 0  # a row's place in its file is below 2^40
    names = ["bucket", "h1", "h2", "id", "row", "start", "known_row", "known_start"]
    kinds = [pa.int32(), *[pa.binary()] * 7]

    def extend(flat: Flat, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, h = flat.anchors(run)
        place = _bucket(h, buckets) * width + _mark(h.astype(np.uint32), width)
        hit = at[(marks[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)]
        turn = np.zeros(len(flat.hashes) + 1, np.int32)
        np.add.at(turn, np.maximum(hit - (PERIOD - 1), flat.first[hit]), 1)
        np.add.at(turn, hit + 1, -1)
        at = np.flatnonzero((np.cumsum(turn[:-1]) > 0) & (flat.rest >= window))
        if not len(at):
            return at, np.empty(0, np.uint64), np.empty(0, np.uint32)
        both = []
        for seed in (1, 2):
            part = run_hashes(flat.hashes, run, seed=seed)
            h = None
            for k in sorted({*range(0, window - run + 1, run), window - run}):
                h = mix(part[at + k] + ODD) if h is None else mix((h ^ part[at + k]) * ODD + np.uint64(seed))
            both.append(h)
        return at, both[0], (both[1] >> np.uint64(32)).astype(np.uint32)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = worker_model(("substring_dedup", key), lambda: np.concatenate([np.frombuffer(zlib.decompress(b), np.uint8) for b in shared.value]))

        def flush(held: list[tuple]) -> pa.RecordBatch:
            h1, h2, ids, rows, start = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((start, rows, ids, h2, h1))
            h1, h2, ids, rows, start = h1[order], h2[order], ids[order], rows[order], start[order]
            again = np.zeros(len(h1), bool)
            again[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            out, known = [], [rows[again], start[again]]
            h1, h2, ids, rows, start = (x[~again] for x in (h1, h2, ids, rows, start))
            for b, at in _by_bucket(_bucket(h1, buckets)):
                at = at[np.lexsort((start[at], rows[at]))]  # texts together compress well
                out.append([b, *(x[at].tobytes() for x in (h1, h2, ids, rows, start)), b"", b""])
            for b, at in _by_bucket(known[0] % buckets):
                at = at[np.lexsort((known[1][at], known[0][at]))]
                out.append([b, b"", b"", b"", b"", b"", known[0][at].tobytes(), known[1][at].tobytes()])
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

        held, size = [], 0
        for batch in batches:
            ids = batch.column("id").fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.searchsorted(files, batch.column("file").to_numpy(zero_copy_only=False)) << shift | batch.column("place").to_numpy(zero_copy_only=False)
            for a, _, texts in text_slices(batch.column("text")):
                flat = Flat(texts)
                at, h1, h2 = extend(flat, marks)
                doc = flat.doc[at] + a
                held.append((h1, h2, ids[doc], rows[doc], flat.place[at].astype(np.uint32)))
                size += len(at)
                if size >= chunk:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def gather(t: pa.Table) -> pa.Table:
        h1, h2, ids, rows, start, known_row, known_start = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in zip(names[1:], (np.uint64, np.uint32, np.int64, np.int64, np.uint32, np.int64, np.uint32), strict=True))
        order = np.argsort(h1)
        same = np.zeros(len(h1) + 1, bool)
        same[1:-1] = h1[order[1:]] == h1[order[:-1]]
        some = order[same[1:] | same[:-1]]  # equal to a neighbour
        some = some[np.lexsort((start[some], rows[some], ids[some], h2[some], h1[some]))]
        again = np.zeros(len(some), bool)
        again[1:] = (h1[some[1:]] == h1[some[:-1]]) & (h2[some[1:]] == h2[some[:-1]])
        rows, start = np.concatenate([rows[some[again]], known_row]), np.concatenate([start[some[again]], known_start])
        order = np.lexsort((start, rows))
        rows, start = rows[order], start[order]
        out = [[b, rows[at].tobytes(), start[at].tobytes()] for b, at in _by_bucket((mix(rows.view(np.uint64)) % np.uint64(buckets)).astype(np.int64))]
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate((("home", pa.int32()), ("row", pa.binary()), ("start", pa.binary())))})

    def spans(t: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(t.column("row").to_pylist()), np.int64)
        start = np.frombuffer(b"".join(t.column("start").to_pylist()), np.uint32).astype(np.int32)
        order = np.lexsort((start, rows))
        rows, start = rows[order], start[order]
        new_row = np.r_[True, rows[1:] != rows[:-1]]
        new_span = new_row | np.r_[True, np.diff(start) > window]
        first = np.flatnonzero(new_span)
        last = np.r_[first[1:] - 1, len(rows) - 1]
        pairs = np.stack([start[first], start[last] + window], 1).astype(np.int32)
        at = np.flatnonzero(new_row[first])
        cut = np.r_[at, len(first)]
        found = rows[first[at]]
        file = files[found >> shift] if shift else np.repeat(files, len(found))
        return pa.table({"file": pa.array(file, pa.int64()), "place": pa.array(found & (1 << (shift or 63)) - 1, pa.int64()), "spans": pa.array([pairs[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    source = docs.select("row.file", "row.place", F.col("id").cast("long").alias("id"), "text")
    sent = source.mapInArrow(send, "bucket int, h1 binary, h2 binary, id binary, row binary, start binary, known_row binary, known_start binary")
    back = sent.groupBy("bucket").applyInArrow(gather, "home int, row binary, start binary")
    out = back.groupBy("home").applyInArrow(spans, "file long, place long, spans binary")
    return out.select(F.struct("file", "place").alias("row"), "spans")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, max_filter_bits: int = 1 << 30) -> DataFrame:
    """Remove every word that is covered by a window of words which also starts earlier.

    Words are runs without ASCII white space, unchanged. A window is ``window`` consecutive words of one
    text; earlier is: with a smaller id, or in the same text with an earlier start. Windows are judged
    on the input. Runs of ``window - 12`` words are hashed at cover positions modulo 13 only: two equal
    windows have such an anchor at the same distance. Anchors seen twice mark a bitmap, 4 bits an anchor
    and ``max_filter_bits`` (128 MB) at most, which bounds what is broadcast; all windows around such
    anchors are then compared by a 96-bit hash of all their words.

    Returns the id, n_words, n_removed, kept (the other words, joined by one space) and removed (spans of
    words, end exclusive). Defined cases: a null text has no words; a very long text is one row like any
    other; a null id counts as larger than any other; of rows with one id the first by place (see
    ``keyed``) is earlier; an empty table gives no rows; other columns are ignored. The id must be an
    integer. The driver holds one number for each file.
    """
    spark = docs.sparkSession
    ship(spark)
    run = window - PERIOD + 1
    if run < 2:
        raise ValueError(f"a window needs {PERIOD + 1} words at least")
    rows = keyed(docs, {id_col: "id", text_col: "text"})
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = size // 5 + 1  # about; only for sizes
    buckets = 8
    while buckets * 2_000_000 < words:
        buckets *= 2
    bits = 1 << 16
    while bits < min(4 * words * len(COVER) // PERIOD, max_filter_bits):
        bits *= 2
    bits = max(bits, 64 * buckets)
    bitmaps = repeated_anchors(rows, "text", run, buckets, bits)
    files = np.sort(np.array([r["file"] for r in rows.select("row.file").distinct().collect()], np.int64))
    found = repeated_starts(rows, files, window, run, buckets, bitmaps, bits)
    joined = rows.join(found.hint("shuffle_hash"), "row", "left").select("id", "text", "spans")

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = words_of(text.as_py())
                removed = np.frombuffer(found.as_py(), np.int32).reshape(-1, 2).tolist() if found.is_valid else []
                last, rest = 0, []
                for a, b in removed:
                    rest += words[last:a]
                    last = b
                rest += words[last:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(rest))
                kept.append(b" ".join(rest).decode("utf-8", "surrogatepass"))
                spans.append([{"start": a, "end": b} for a, b in removed])
            new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *new], names=["id", "n_words", "n_removed", "kept", "removed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(remove, f"id {kind}, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>").withColumnRenamed("id", id_col)
