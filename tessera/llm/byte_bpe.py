"""Byte-level BPE encoding and decoding with padded numpy matrices."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ship, text_slices, worker_model

#: No pair, or a place after the end of a piece.
NONE = np.int32(2**31 - 1)
#: Widths of the matrices of many rows; a longer piece is a matrix of one row, see ``merge_row``.
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 128)


class PairTable:
    """Open addressing from a pair of token ids to the id of their concatenation."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], slot[~put]
            taken = self.keys[slot] != -1
            slot[taken] = (slot[taken] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        flat_keys, flat_slot, flat_out = keys.ravel(), slot.ravel(), out.ravel()
        while len(todo):
            at = flat_slot[todo]
            there = self.keys[at]
            found = there == flat_keys[todo]
            flat_out[todo[found]] = self.values[at[found]]
            todo = todo[~found & (there != -1)]
            flat_slot[todo] = (flat_slot[todo] + 1) & self.mask
        return out


class Codec:
    """Encodes as the tiktoken library does with the same ranks and pattern, without special tokens."""

    def __init__(self, path: str, pattern: str, cache_size: int = 150_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.table = PairTable(pairs)
        self.find = regex.compile(pattern).findall
        self.tangled = re.compile(r"\s \s|\s \Z").search
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size

    def merge_row(self, piece: bytes) -> bytes:
        """The rounds of one wide row. The leftmost pair of least rank merges, and with it, in the same round, all others of that rank.

        One after another they would merge from left to right, as here, unless a merge made a pair of a
        lesser rank, which would go first: in such a round only the leftmost pair merges.
        """
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        rank = self.table.get(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != NONE:
            hit = np.flatnonzero(rank == least)
            nth = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) > 1, nth, 0))
            hit = hit[(nth - run) % 2 == 0]  # of overlapping pairs the left one merges
            while True:
                new = ids.copy()
                new[hit] = least
                new, around = np.delete(new, hit + 1), np.delete(rank, hit)
                at = hit - np.arange(len(hit))
                near = np.unique(np.concatenate([at - 1, at]))
                near = near[(near >= 0) & (near < len(around))]
                around[near] = self.table.get(new[near], new[near + 1])
                if len(hit) == 1 or not len(near) or around[near].min() > least:
                    break
                hit = hit[:1]
            ids, rank = new, around
        return ids.astype("<u4").tobytes()

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Each round, every row merges its leftmost pair of least rank and is compacted; finished rows leave."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        length = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < length[:, None], self.byte[raw], -1).astype("<i4")
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.table.get(ids[:, :-1], ids[:, 1:])
        done = [b""] * n
        row, columns = np.arange(n), np.arange(width)
        while len(row):
            at = rank.argmin(1)
            least = rank[np.arange(len(row)), at]
            ready = least == NONE
            if ready.any():
                for k in np.flatnonzero(ready):
                    done[row[k]] = ids[k, : length[k]].tobytes()
                keep = ~ready
                row, ids, rank, length, at, least = row[keep], ids[keep], rank[keep], length[keep], at[keep], least[keep]
                if not len(row):
                    break
            every = np.arange(len(row))
            behind = columns > at[:, None]
            ids[:, :-1] = np.where(behind[:, :-1], ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = -1, NONE
            ids[every, at] = least
            length -= 1
            right = np.where(at + 1 < width, ids[every, np.minimum(at + 1, width - 1)], -1)
            rank[every, at] = self.table.get(least, right)
            some = np.flatnonzero(at > 0)
            rank[some, at[some] - 1] = self.table.get(ids[some, at[some] - 1], least[some])
        return done

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of different pieces, as little-endian unsigned 32-bit integers."""
        out, by_width = {}, {w: [] for w in WIDTHS}
        for p in pieces:
            whole = self.ranks.get(p)
            if whole is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(p) > WIDTHS[-1]:
                out[p] = self.merge_row(p)
            else:
                by_width[next(w for w in WIDTHS if len(p) <= w)].append(p)
        for width, some in by_width.items():
            for k in range(0, len(some), step := max(256, 400_000 // width)):
                part = some[k : k + step]
                out.update(zip(part, self.merge_matrix(part, width), strict=True))
        return out

    def chunks(self, text: str) -> list[str]:
        """Parts that can be cut into pieces separately: a single space always starts a new piece, unless white space goes on across it."""
        if self.tangled(text):
            return [text]
        parts = text.split(" ")
        return [parts[0], *(" " + x for x in parts[1:])]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        split = [self.chunks(t) for t in texts]
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        new = {c for chunks in split for c in chunks}
        new.difference_update(self.cache)
        pieces = {c: [p.encode("utf-8", "surrogatepass") for p in self.find(c)] for c in new}
        ids = self.encode_pieces(list({p for ps in pieces.values() for p in ps}))
        fresh = {c: b"".join([ids[p] for p in ps]) for c, ps in pieces.items()}
        self.cache.update((c, x) for c, x in fresh.items() if len(c) <= 64)
        known = self.cache.get
        out = []
        for chunks in split:
            try:
                out.append(b"".join(map(known, chunks)))
            except TypeError:  # a long chunk isn't kept
                out.append(b"".join([fresh[c] if c in fresh else self.cache[c] for c in chunks]))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def bpe(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Encode whole texts, then decode the ids again.

    Returns the columns ``carry`` (default: all) and token_ids (binary, little-endian unsigned 32-bit),
    n_tokens and decoded (binary); input columns with one of these names are replaced. A null or empty
    text has no tokens; repeated rows each give a row; an empty table gives none; a very long text is
    encoded whole, and so is a very long piece. Rows never shuffle. ``ranks_path`` must be readable on
    the executors.
    """
    ship(docs.sparkSession)
    own = ("token_ids", "n_tokens", "decoded")
    names = [c for c in (docs.columns if carry is None else carry) if c not in own]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = worker_model(("byte_bpe", ranks_path, pattern), lambda: Codec(ranks_path, pattern))
        for batch in batches:
            for a, b, texts in text_slices(batch.column("__text"), 600_000):
                ids = c.encode_batch(texts)
                part = batch.slice(a, b - a)
                new = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([c.decode(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), *new], names=[*(f"__c{k}" for k in range(len(names))), *own])

    rows = docs.selectExpr(*(f"`{c}` as `__c{i}`" for i, c in enumerate(names)), f"`{text_col}` as __text")
    schema = ", ".join([*(f"`__c{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)), "token_ids binary, n_tokens long, decoded binary"])
    return rows.mapInArrow(run, schema).selectExpr(*(f"`__c{i}` as `{c}`" for i, c in enumerate(names)), *own)
