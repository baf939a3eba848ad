"""Language identification by cross-parsing: suffix automata of labelled text per language."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship, text_slices, worker_model

UNKNOWN = "und"
#: Symbol 0 is the gap between words; letters that are in no training text share the last symbol.
GAP = 0
ODD = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> str:
    """Lower-case letters; everything between two of them is one space, and there is one at either end."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """The transitions of each state of the automaton that reads exactly the substrings of ``text``."""
    follow: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return follow


class Transitions:
    """A hash table from state + symbol to the next state, with linear probing; at most a quarter of it is filled."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32 if not len(values) or values.max() < 2**31 else np.int64)
        todo = np.arange(len(keys))
        at = self._home(keys)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]  # of several, one stays
            own = self.keys[at] == keys[todo]
            self.values[at[own]] = values[todo[own]]
            todo, at = todo[~own], (at[~own] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * ODD) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none; ``keys`` is one contiguous array."""
        at = self._home(keys)
        found = self.keys[at]
        out = self.values[at]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at = (at[open_] if len(at) != len(open_) else at) + 1 & self.mask
            found = self.keys[at]
            out[open_] = self.values[at]
            more = (found != keys[open_]) & (found >= 0)
            open_, at = open_[more], at[more]
        return out


class CrossParser:
    """Parses texts into longest phrases that occur in a language's text, all languages side by side.

    Every letter of the training texts is a symbol. A table of all states and symbols of up to
    ``dense_cells`` cells is stored whole; above (scripts with thousands of letters) the transitions
    that exist are hashed. Both give the same phrases.
    """

    def __init__(self, training: dict[str, str], block: int = 1024, dense_cells: int = 1 << 25):
        self.langs = sorted(training)
        texts = {k: " ".join(letters(v).split()) for k, v in training.items()}
        alphabet = sorted(set().union(*texts.values()) - {" "})
        self.n_symbols = n = len(alphabet) + 2
        self.block = block
        self.symbol = {c: i + 1 for i, c in enumerate(alphabet)} | {" ": GAP}
        self.bits = np.array([np.log2(max(2, len(texts[k]))) for k in self.langs])
        # a state is known by the place of its first cell; one automaton at a time is held as it was built
        starts, sizes, edges = [], [], []
        for k in self.langs:
            states = suffix_automaton(texts[k])
            starts.append(sum(sizes) * n)
            sizes.append(len(states))
            edges.append(self._edges(states, starts[-1]))
            del states
        self.starts = np.array(starts, np.int64)
        # by language and symbol: where it goes on after a phrase ended, and whether the symbol is a phrase of its own
        self.again = np.full((len(self.langs), n), -1, np.int64)
        for row, start, (at, to) in zip(self.again, self.starts, edges, strict=True):
            root = at < start + n
            row[at[root] - start] = to[root]
        self.lone = self.again < 0
        self.again = np.where(self.lone, self.starts[:, None], self.again)
        self.table = self.next = None
        if sum(sizes) * n <= dense_cells:
            parts = [self._table(size * n, *x) for size, *x in zip(sizes, self.starts, edges, self.again, self.lone, strict=True)]
            self.table = np.concatenate([np.zeros(0, np.int32), *parts])
        else:
            self.next = Transitions(*(np.concatenate(x) for x in zip(*edges, strict=True)))
        wide = np.full(0x110000, -1, np.int32)
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
                wide[i] = self.n_symbols - 1
        for c in alphabet:
            wide[ord(c)] = self.symbol[c]
        self.of_point = wide.astype(np.min_scalar_type(-self.n_symbols))

    def _edges(self, states: list[dict[str, int]], start: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, states), np.int64, len(states))
        symbol = np.fromiter((self.symbol[c] for follow in states for c in follow), np.int64, sizes.sum())
        target = np.fromiter((t for follow in states for t in follow.values()), np.int64, sizes.sum())
        return np.repeat(np.arange(len(states)), sizes) * self.n_symbols + symbol + start, target * self.n_symbols + start

    def _table(self, cells: int, start: int, edges: tuple[np.ndarray, np.ndarray], again: np.ndarray, lone: np.ndarray) -> np.ndarray:
        """For state and symbol: where to go next times 4, and how many phrases end by that."""
        out = np.tile((again * 4 + 1 + lone).astype(np.int32), cells // self.n_symbols)
        out[: self.n_symbols] = start * 4 + 1  # nothing was read before
        out[edges[0] - start] = edges[1] * 4
        return out

    def _step(self, state: np.ndarray, symbol: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and how many phrases end by that; ``lang`` is the number of each state's language."""
        if self.table is not None:
            got = self.table[state + symbol]
            return got >> 2, got & 3
        got = self.next((state + symbol).ravel()).reshape(state.shape).astype(np.int64)
        ended = np.zeros(state.shape, np.int32)
        miss = np.nonzero(got < 0)
        at, c = np.broadcast_to(lang, state.shape)[miss], np.broadcast_to(symbol, state.shape)[miss]
        # what was read is a phrase, unless it is empty; a symbol that the language doesn't have is one too
        ended[miss] = (state[miss] != self.starts[at]).astype(np.int32) + self.lone[at, c]
        got[miss] = self.again[at, c]
        return got, ended

    def symbols(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        s = self.of_point[raw]
        word = s >= 0
        keep = word.copy()
        keep[1:] |= word[:-1]  # one gap after each word
        s = s[keep]
        return np.where(s < 0, GAP, s).astype(np.min_scalar_type(self.n_symbols))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, its number of symbols, and its number of phrases in each language.

        A text is read in blocks of ``block`` symbols, so that all blocks of all texts and all languages
        advance together. A block is first parsed as if a phrase began with it. Then every block whose
        predecessor ended in another state is read again from that state, beside the first reading,
        until both are in one state (mostly after a few symbols): from there on they agree. Blocks that
        never agree hand a new state on to the next one, and so on, until no state changes. The counts
        are those of one parse of the whole text.
        """
        symbols = [self.symbols(t) for t in texts]
        length = np.array([len(s) for s in symbols], np.int64)
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        if not self.langs or not length.sum():
            return length, total
        n_blocks = -(-length // self.block)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        sizes = np.minimum(self.block, length[owner] - nth * self.block)
        first = (np.cumsum(length) - length)[owner] + nth * self.block
        flat = np.concatenate([*symbols, np.zeros(self.block, symbols[0].dtype)])
        every = np.arange(len(self.langs))[:, None]
        order = np.argsort(-sizes, kind="stable")
        state = np.repeat(self.starts[:, None], len(order), 1)
        tally = np.zeros(state.shape, np.int32)
        alive = np.searchsorted(-sizes[order], -np.arange(1, sizes[order[0]] + 1), side="right")
        begin = first[order]
        for step, n in enumerate(alive):
            state[:, :n], ended = self._step(state[:, :n], flat[begin[:n] + step], every)
            tally[:, :n] += ended
        end, count = np.empty_like(state), np.empty_like(tally)
        end[:, order], count[:, order] = state, tally
        read_from = np.repeat(self.starts[:, None], len(owner), 1)
        while True:
            before = np.where(nth == 0, self.starts[:, None], np.roll(end, 1, axis=1))
            lang, at = np.nonzero(before != read_from)
            if not len(at):
                break
            more, last = self._again(lang, first[at], sizes[at], read_from[lang, at], before[lang, at], flat)
            count[lang, at] += more
            end[lang, at] = np.where(last >= 0, last, end[lang, at])
            read_from = before
        closing = np.cumsum(n_blocks)[n_blocks > 0] - 1
        count[:, closing] += end[:, closing] != self.starts[:, None]
        for k in range(len(self.langs)):
            total[:, k] = np.bincount(owner, count[k], len(texts))
        return length, total

    def _again(self, lang: np.ndarray, first: np.ndarray, sizes: np.ndarray, old: np.ndarray, new: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of blocks read from state ``new`` instead of ``old``: how many phrases more end, and the last state, -1 if it is the same."""
        more, last = np.zeros(len(lang), np.int32), np.full(len(lang), -1, np.int64)
        at, step = np.arange(len(lang)), 0
        while len(at):
            symbol = flat[first[at] + step]
            old, fewer = self._step(old, symbol, lang[at])
            new, ended = self._step(new, symbol, lang[at])
            more[at] += ended - fewer
            step += 1
            apart = old != new
            through = apart & (step == sizes[at])
            last[at[through]] = new[through]
            on = apart & ~through
            at, old, new = at[on], old[on], new[on]
        return more, last

    def classify(self, texts: list[str | None], sharpness: float = 12.0) -> list[tuple[str, float, float | None, int]]:
        """Language, score, normalised phrases (bits a symbol) and symbols of each text; ties go to the first name."""
        length, total = self.phrases([t or "" for t in texts])
        out = []
        for n, counts in zip(length, total, strict=True):
            if not n or not self.langs:
                out.append((UNKNOWN, 0.0, None, int(n)))
                continue
            rate = counts * self.bits / n
            best = int(rate.argmin())
            share = (rate[best] / rate) ** sharpness
            out.append((self.langs[best], float(1 / share.sum()), float(rate[best]), int(n)))
        return out


def training_sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, rows_per_lang: int, max_row_chars: int, chars_per_lang: int) -> dict[str, str]:
    """A bounded sample of labelled rows: at most ``rows_per_lang`` different texts a language, by a hash of id and text.

    Texts over ``max_row_chars`` characters are not learned from, unless the language has no other: then
    the first ``chars_per_lang`` characters of its shortest text are. A language's rows are dealt into
    buckets by that hash, four for each row wanted; the least hashes of the buckets are its sample, of
    which texts are taken, in the order of the hash, until they have ``chars_per_lang`` characters.
    """
    labelled = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).where(F.length(text_col) > 0)
    every = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"), F.length(text_col).alias("n"))
    fits = F.col("n") <= max_row_chars
    least = every.groupBy("lang", F.when(fits, F.pmod("h", F.lit(4 * rows_per_lang))).alias("bucket")).agg(F.min("h").alias("h"))
    hashes: dict[str, list[int]] = {}
    for r in least.collect():
        hashes.setdefault(r["lang"], []).extend([r["h"]] if r["bucket"] is not None else [])
    out: dict[str, str] = {}
    if long := [lang for lang, found in hashes.items() if not found]:
        shortest = every.where(F.col("lang").isin(long)).groupBy("lang").agg(F.min(F.struct("n", "h", F.substring("text", 1, chars_per_lang).alias("text"))).alias("first"))
        out |= {r["lang"]: r["first"]["text"] for r in shortest.collect()}
    if wanted := [(lang, h) for lang, found in hashes.items() for h in sorted(found)[:rows_per_lang]]:
        chosen = F.broadcast(docs.sparkSession.createDataFrame(wanted, "lang string, h long"))
        taken: dict[str, list[str]] = {}
        for r in sorted(every.where(fits).join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect(), key=lambda r: r["h"]):
            have = taken.setdefault(r["lang"], [])
            if sum(map(len, have)) < chars_per_lang:
                have.append(r["text"])
        out |= {lang: "\n".join(have) for lang, have in taken.items()}
    return {lang: text for lang, text in out.items() if any(map(str.isalpha, text))}


def identify(docs: DataFrame, training: dict[str, str], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Predict the language of every whole text from the training text of each language.

    The text of each language becomes a suffix automaton. A text is parsed into longest phrases that
    occur in it; phrases times the bits of a position in the training text, per symbol, are the
    cross-parsing entropy, and the language with the least wins. The automata are built once and
    broadcast; their size follows that of the training text, which ``training_sample`` bounds (about
    one cell of 4 bytes for each character, letter and state: 10 MB a language of 40,000 characters).
    Rows never shuffle.

    Returns the columns ``carry`` (default: all) and lang_pred, score (0 to 1: the winner's share of
    the languages' weights), bits_per_symbol, n_symbols; input columns named as one of these are replaced. A null
    text, a text without letters and all texts if nothing was learned give ``und``, 0, null and the symbols there are. A very
    long text is parsed whole; repeated rows each give a row; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    own = ("lang_pred", "score", "bits_per_symbol", "n_symbols")
    names = [c for c in (docs.columns if carry is None else carry) if c not in own]
    shared = spark.sparkContext.broadcast(CrossParser(training))
    key = uuid.uuid4().hex
    give_back()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = worker_model(("language_id", key), lambda: shared.value)
        for batch in batches:
            for a, b, texts in text_slices(batch.column("__text")):
                found, part = parser.classify(texts), batch.slice(a, b - a)
                new = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *new], names=[*(f"__c{i}" for i in range(len(names))), *own])

    rows = docs.selectExpr(*(f"`{c}` as `__c{i}`" for i, c in enumerate(names)), f"`{text_col}` as __text")
    schema = ", ".join([*(f"`__c{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)), "lang_pred string, score double, bits_per_symbol double, n_symbols long"])
    return rows.mapInArrow(run, schema).selectExpr(*(f"`__c{i}` as `{c}`" for i, c in enumerate(names)), *own)


def language_id(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, rows_per_lang: int = 80, max_row_chars: int = 20_000, chars_per_lang: int = 40_000) -> DataFrame:
    """Learn from the rows where ``learn`` holds, then predict every row; see ``training_sample`` and ``identify``."""
    return identify(docs, training_sample(docs, learn, id_col, text_col, lang_col, rows_per_lang, max_row_chars, chars_per_lang), text_col, carry)
