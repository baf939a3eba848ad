"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, ship, small, stable, text_slices, worker_model

#: A-Z become a-z; of ASCII only digits and letters are parts of words; every byte from 0x80 is one.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class WuManber:
    """Searches many patterns of one length ``m`` in a list of words; a block is two words (one if m is 1).

    The shift of a block is its least distance from the end of any pattern. A block with shift 0 leads
    to the patterns that end with it, by their first word; those are compared word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str | None]]):
        self.m = m = len(next(iter(patterns)))
        self.ids: dict[bytes, int] = {}
        for p in patterns:
            for w in p:
                self.ids.setdefault(w, len(self.ids))
        self.shift: dict[int, int] = {}
        self.ends: dict[int, dict[bytes, list[tuple[list[bytes], set[str]]]]] = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            key = 0
            for at in range(min(1, m - 1), m):
                key = self._block(p, at)
                self.shift[key] = min(self.shift.get(key, m), m - 1 - at)
            self.ends[key][p[0]].append((list(p), items))
        self.ends = {k: dict(v) for k, v in self.ends.items()}

    def _block(self, words, at: int) -> int:
        last = self.ids[words[at]]
        return last if self.m == 1 else self.ids[words[at - 1]] << 32 | last

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Starts of all occurrences, in order, with the items of the pattern."""
        m, n, known, shift, ends = self.m, len(words), self.ids.get, self.shift.get, self.ends
        at = m - 1
        while at < n:
            key = known(words[at])
            if key is None:
                at += m
                continue
            if m > 1:
                before = known(words[at - 1])
                if before is None:
                    at += m - 1
                    continue
                key |= before << 32
            step = shift(key, m - 1 or 1)
            if step:
                at += step
                continue
            start = at - m + 1
            for p, items in ends[key].get(words[start], ()):
                if words[start : at + 1] == p:
                    yield start, items
            at += 1


def windows(words: list[bytes], n: int) -> Iterator[tuple[bytes, ...]]:
    """Windows of n words; fewer words, but not none, are one window."""
    if words:
        for i in range(max(1, len(words) - n + 1)):
            yield tuple(words[i : i + n])


Tables = list[dict[tuple[bytes, ...], set[str | None]]]


def blocks(items: Iterable[tuple[object, str | None]], n: int, per_block: int) -> Iterator[Tables]:
    """Blocks of ``per_block`` windows, about: for each length a dict from window to item ids. One block at a time is made."""
    now, held = defaultdict(lambda: defaultdict(set)), 0
    for item, text in items:
        for w in windows(words_of(text), n):
            now[len(w)][w].add(None if item is None else str(item))
            held += 1
        if held >= per_block:
            yield [dict(x) for x in now.values()]
            now, held = defaultdict(lambda: defaultdict(set)), 0
    if held:
        yield [dict(x) for x in now.values()]


def disjoint(spans: Iterable[tuple[int, int]]) -> list[dict[str, int]]:
    """Sorted spans of which none meet, from any spans (end exclusive)."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [{"start": a, "end": b} for a, b in merged]


def by_text(items: Iterable[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


OUT = {"n_words": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "items": pa.list_(pa.string())}
OUT_SQL = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def search(rows: DataFrame, block: Tables, hits_only: bool) -> DataFrame:
    """The columns of ``rows`` but `__text`, with n_words, spans and items for one block; with ``hits_only`` only rows with a window."""
    tables, key = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    names = [c for c in rows.columns if c != "__text"]
    kinds = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), OUT_SQL])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = worker_model(("decontaminate", key), lambda: [WuManber(x) for x in tables.value])
        for batch in batches:
            for a, b, texts in text_slices(batch.column("__text")):
                found = []
                for text in texts:
                    words, at, items = words_of(text), [], set()
                    for f in finders:
                        for start, more in f.find(words):
                            at.append((start, start + f.m))
                            items |= more
                    found.append((len(words), disjoint(at), by_text(items)))
                part = batch.slice(a, b - a)
                new = [pa.array([x[i] for x in found], t) for i, t in enumerate(OUT.values())]
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *new], names=[*names, *OUT])
                yield out.filter(pa.array([bool(x[1]) for x in found], pa.bool_())) if hits_only else out

    return rows.select(*names, "__text").mapInArrow(run, kinds)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: list[str] | None = None, per_block: int = 500_000) -> DataFrame:
    """Find all windows of ``n`` consecutive benchmark words in whole document texts.

    Words: A-Z in lower case, maximal runs of digits, letters and all that isn't ASCII. An item of fewer
    words, but not none, is one window. The benchmark is a stated query set, read in blocks of
    ``per_block`` windows (some 150 MB of tables at most, and one item more). One block is one pass over
    the documents, which never shuffle. With several blocks, each is searched and what it found is
    stored before the next one is read, so that the driver and a worker hold one block at a time; the
    rows with windows are then joined to the documents.

    Returns the columns ``carry`` (default: the id) and n_words, spans (disjoint, sorted, end
    exclusive), items (ids as text, sorted, of items with an occurring window). Defined cases: null and
    empty texts have no words; a very long text is searched whole; a null item id is a null item, the
    last one; items with equal ids are one; repeated rows each give a row; an empty table gives no rows,
    an empty benchmark no windows; input columns named as one of these three are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    carried = [c for c in ([id_col] if carry is None else carry) if c not in OUT]
    names = {c: f"__c{i}" for i, c in enumerate(carried)}
    back = [F.col(new).alias(old) for old, new in names.items()]
    source = blocks(((r[0], r[1]) for r in benchmark.select(item_col, item_text_col).toLocalIterator()), n, per_block)
    first, second = next(source, []), next(source, None)
    if second is None:
        rows = docs.select(*(F.col(f"`{c}`").alias(new) for c, new in names.items()), F.col(f"`{text_col}`").alias("__text"))
        return search(rows, first, False).select(*back, *OUT)
    plain = keyed(docs.withColumn("__text", F.col(f"`{text_col}`")), names | {"__text": "__text"})
    hits = None
    for block in chain((first, second), source):
        found = stable(search(plain.select("row", "__text"), block, True))
        hits = found if hits is None else hits.unionByName(found)
    hits = stable(hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")))
    # without patterns a search counts words
    counted = search(plain.join(small(hits.withColumnsRenamed({"spans": "__spans", "items": "__items"})), "row", "left"), [], False)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [disjoint((s["start"], s["end"]) for s in x or ()) for x in batch.column("__spans").to_pylist()]
            items = [by_text(set(x or ())) for x in batch.column("__items").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names.values()), batch.column("n_words"), pa.array(spans, OUT["spans"]), pa.array(items, OUT["items"])], names=[*names.values(), *OUT])

    kinds = ", ".join([*(f"`{c}` {counted.schema[c].dataType.simpleString()}" for c in names.values()), OUT_SQL])
    return counted.select(*names.values(), "n_words", "__spans", "__items").mapInArrow(merge, kinds).select(*back, *OUT)
