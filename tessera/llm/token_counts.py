"""Token counts under a unigram vocabulary, without making the tokens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import ship, text_slices, worker_model

SPACE = "▁"
#: An unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file with their scores, without control, unknown and byte pieces."""
    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


class AhoCorasick:
    """The automaton of all pieces over bytes: a dense step table, and for each state its longest piece and the next shorter one."""

    def __init__(self, pieces: list[bytes], scores: list[float]):
        used = sorted({b for p in pieces for b in p})
        self.symbol = np.full(256, len(used), np.int64)
        self.symbol[used] = np.arange(len(used))
        n = self.n_symbols = len(used) + 1
        children: list[dict[int, int]] = [{}]
        length, score, level = [0], [0.0], [0]
        for p, s in zip(pieces, scores, strict=True):
            at = 0
            for b in p:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    length.append(0)
                    score.append(0.0)
                    level.append(level[at] + 1)
                at = children[at][b]
            length[at], score[at] = len(p), s
        states = len(children)
        self.length, self.score = np.array(length, np.int64), np.array(score)
        step = np.zeros((states, n), np.int32)
        fail, shorter = np.zeros(states, np.int32), np.zeros(states, np.int32)
        edges = [(s, int(self.symbol[b]), t) for s, c in enumerate(children) for b, t in c.items()]
        parent, sym, child = (np.array(x, np.int64) for x in zip(*edges, strict=True)) if edges else (np.empty(0, np.int64),) * 3
        depth = np.array(level)
        for d in range(max(level) + 1):
            here = np.flatnonzero(depth == d)
            if d:
                step[here] = step[fail[here]]
                shorter[here] = np.where(self.length[fail[here]] > 0, fail[here], shorter[fail[here]])
            e = depth[parent] == d
            fail[child[e]] = step[parent[e], sym[e]] if d else 0
            step[parent[e], sym[e]] = child[e]
        self.step, self.shorter = step.ravel(), shorter
        self.longest = np.where(self.length > 0, np.arange(states), shorter)


class UnigramCounter:
    """Best path by score, counting its pieces; an unknown character counts its bytes (byte fallback).

    Ties as in the public unigram tokenizers: a path to a place is replaced by a strictly better one
    only, and the starts of its last piece are tried from left to right, so the longest last piece wins.
    """

    def __init__(self, pieces: list[tuple[str, float]], cache_size: int = 300_000):
        self.auto = AhoCorasick([p.encode() for p, _ in pieces], [s for _, s in pieces])
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, tuple[int, float]] = {}
        self.cache_size = cache_size

    def words(self, text: str) -> list[str]:
        """The text's parts from one space to the next, without it; a text that doesn't start with one gets one."""
        if not text:
            return []
        s = text.replace(SPACE, " ")
        return (s[1:] if s[0] == " " else s).split(" ")

    def solve(self, words: list[str]) -> list[tuple[int, float]]:
        """Pieces and score of each word with its space before it."""
        out: list[tuple[int, float]] = [(0, 0.0)] * len(words)
        raw = [(SPACE + w).encode("utf-8", "surrogatepass") for w in words]
        order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
        at = 0
        while at < len(order):
            width = len(raw[order[at]])
            part = order[at : at + max(1, 3_000_000 // width)]
            at += len(part)
            for i, n, s in zip(part, *self._matrix([raw[i] for i in part], width), strict=True):
                out[i] = (int(n), float(s))
        return out

    def _matrix(self, raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        a, n = self.auto, len(raw)
        size = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(n, width).T.copy()
        lead = (data & 0xC0) != 0x80
        best = np.full((width + 1, n), -np.inf)
        count = np.zeros((width + 1, n), np.int64)
        best[0] = 0
        state, begin = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = np.searchsorted(-size, -np.arange(1, width + 1), side="right")
        for e, m in enumerate(alive):
            begin[:m] = np.where(lead[e, :m], e, begin[:m])
            state[:m] = a.step[state[:m] * a.n_symbols + a.symbol[data[e, :m]]]
            now = a.longest[state[:m]]
            row = np.flatnonzero(now)
            now = now[row]
            single = np.zeros(m, bool)
            while len(row):
                long = a.length[now]
                start = e + 1 - long
                got = best[start, row] + a.score[now]
                better = got > best[e + 1, row]
                r = row[better]
                best[e + 1, r] = got[better]
                count[e + 1, r] = count[start[better], r] + 1
                single[row] |= start == begin[row]
                now = a.shorter[now]
                more = now > 0
                row, now = row[more], now[more]
            last = np.ones(m, bool) if e + 1 == width else lead[e + 1, :m] | (size[:m] == e + 1)
            row = np.flatnonzero(last & ~single)
            got = best[begin[row], row] + self.unknown
            better = got > best[e + 1, row]
            row, got = row[better], got[better]
            best[e + 1, row] = got
            count[e + 1, row] = count[begin[row], row] + (e + 1 - begin[row])
        return count[size, np.arange(n)], best[size, np.arange(n)]

    def count(self, texts: list[str]) -> list[tuple[int, float]]:
        split = [self.words(t) for t in texts]
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        new = list({w for ws in split for w in ws}.difference(self.cache))
        fresh = dict(zip(new, self.solve(new), strict=True))
        self.cache.update((w, x) for w, x in fresh.items() if len(w) <= 64)
        get = lambda w: self.cache.get(w) or fresh[w]
        out = []
        for ws in split:
            n, s = 0, 0.0
            for k, x in map(get, ws):
                n += k
                s += x
            out.append((n, s))
        return out


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of whole texts under the unigram vocabulary of a sentencepiece file.

    Spaces become word starts and one is put before the text; pieces never go across a word start, so
    each different word is solved once. An Aho-Corasick automaton finds all pieces that end at a place;
    dynamic programming carries the best score and the count of pieces. Returns the id, n_tokens and
    score (sum of the pieces' scores). A null or empty text has no tokens; a very long text is counted
    whole; repeated rows each give a row; an empty table gives none; other columns are ignored; rows
    never shuffle. ``model_path`` must be readable on the executors.
    """
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_model(("token_counts", model_path), lambda: UnigramCounter(vocabulary(model_path)))
        for batch in batches:
            found = [x for _, _, texts in text_slices(batch.column("text")) for x in counter.count(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())], names=["id", "n_tokens", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, f"id {kind}, n_tokens long, score double").withColumnRenamed("id", id_col)
