"""Near-duplicate classes by BagMinHash signatures, banding and multiset overlap."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import attach_by_key, keyed, ship, small, stable, text_slices, worker_model
from .text_hash import ODD, mix, run_hashes, scaled, word_hashes, words_of


def shingles(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's different runs of n words, sorted, and how often each occurs. A shorter text, if not empty, is one run."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = word_hashes(words)
    return np.unique(run_hashes(h, min(n, len(words))), return_counts=True)


class BagMinHash:
    """Signatures whose slots are equal with the probability of the weighted Jaccard similarity.

    The weights (counts) are cut at 1, 2, 4, 8 ...: each element has a Poisson process for each of
    these blocks of the weight axis, whose points have a time, a slot and a weight level within the
    block. Blocks under the weight count whole; in the block that holds the weight, points above it are
    thinned out. A slot holds the first time of all its points, which is the same number for the same
    point of any other bag. Points after the time by which every slot is filled, with high
    probability, are never made; a bag with an empty slot is done again with that time doubled.
    """

    def __init__(self, slots: int = 125, seed: int = 1):
        self.m, self.seed = slots, seed

    def __call__(self, elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Signatures, n x slots, of the bags 0 to n-1; owner: the bag of each element. An empty bag's times are infinite."""
        out = np.full((n, self.m), np.inf)
        total = np.bincount(owner, weights, n)
        stop = np.divide(np.log(self.m) + 5, total, out=np.zeros(n), where=total > 0)
        todo = total > 0
        while todo.any():
            out[todo] = np.inf
            pick = todo[owner]
            self._points(elements[pick], weights[pick], owner[pick], stop, out)
            todo &= np.isinf(out).any(1)
            stop[todo] *= 2
        return out

    def _points(self, elements, weights, owner, stop, out) -> None:
        low = 0
        while len(elements):
            size = max(1, low)  # the block [low, low + size)
            start = mix(elements ^ mix(np.full(1, low, np.uint64) + scaled(self.seed)))
            at = np.arange(len(elements))
            time = np.zeros(len(elements))
            step = 0
            while len(at):
                step += 1
                r = mix(start[at] + scaled(step))
                time[at] -= np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (self.m * size)
                at_time = time[at]
                early = at_time <= stop[owner[at]]
                at, r, at_time = at[early], mix(r[early] ^ ODD), at_time[early]
                slot = ((r >> np.uint64(32)) * np.uint64(self.m) >> np.uint64(32)).astype(np.int64)
                level = low + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
                inside = level < weights[at]
                np.minimum.at(out, (owner[at][inside], slot[inside]), at_time[inside])
            low += size
            more = weights > low
            elements, weights, owner = elements[more], weights[more], owner[more]


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of so many slots; the band's number is part of it."""
    bits = signatures.view(np.uint64)
    bands = bits.shape[1] // rows
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * ODD), (len(bits), bands))
    for k in range(rows):
        h = mix((h ^ bits[:, k : bands * rows : rows]) + ODD)
    return h


def sign(rows: DataFrame, n: int, slots: int, band_slots: int) -> DataFrame:
    """(row, id, bag, n_shingles, bands) of each (row, id, text); bag is a 128-bit hash of the multiset of shingles, null without words."""
    ship(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = worker_model(("near_dedup", slots), lambda: BagMinHash(slots))
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text"), 1_000_000):
                bags = [shingles(t, n) for t in texts]
                sizes = [len(e) for e, _ in bags]
                owner = np.repeat(np.arange(b - a), sizes)
                signatures = signer(np.concatenate([e for e, _ in bags]), np.concatenate([c for _, c in bags]), owner, b - a)
                found = band_hashes(signatures, band_slots).view(np.int64)
                part = batch.slice(a, b - a)
                keys = [xxh3_128_digest(e.tobytes() + c.tobytes()) if len(e) else None for e, c in bags]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(keys, pa.binary()), pa.array([int(c.sum()) for _, c in bags], pa.int64()), bands], names=["row", "id", "bag", "n_shingles", "bands"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("row", "id")}
    return rows.select("row", "id", "text").mapInArrow(run, f"row {kinds['row']}, id {kinds['id']}, bag binary, n_shingles long, bands array<long>")


def grams(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, grams) for the rows (node, row) of ``wanted``: sorted hashes of shingle and occurrence, so that multiset overlap is set overlap."""
    picked = rows.select("row", "text").join(small(wanted), "row").select("node", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in (t for _, _, texts in text_slices(batch.column("text")) for t in texts):
                e, c = shingles(text, n)
                nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                out.append(np.sort(mix(np.repeat(e, c) + nth.astype(np.uint64) * ODD)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "grams"])

    return picked.mapInArrow(run, "node long, grams binary")


def verified(pairs: DataFrame, store: DataFrame, threshold: float, pairs_per_task: int = 5000) -> DataFrame:
    """(a, b, similarity) of the stored pairs (a, b) whose multisets of shingles have at least that Jaccard similarity.

    A node of very many pairs is spread: its grams go to several tasks, once to each.
    """
    parts = -(-pairs.count() // pairs_per_task) or 1

    def with_grams(rows: DataFrame, key: str, other: str, name: str) -> DataFrame:
        sizes = stable(rows.groupBy(key).agg(F.count("*").alias("n")).coalesce(parts))
        groups = store.select(F.col("node").alias(key), F.col("grams").alias(name)).join(small(sizes), key)
        return attach_by_key(rows, groups, key, "n", F.col(other), sizes).drop("n")

    # the node that fewer pairs share is joined first, so that its grams are what moves with the pairs
    both = with_grams(with_grams(pairs, "b", "a", "gb"), "a", "b", "ga").select("a", "b", "ga", "gb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column("ga"), batch.column("gb"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                few, many = (a, b) if len(a) < len(b) else (b, a)
                at = np.searchsorted(many, few)
                common = int((many[np.minimum(at, len(many) - 1)] == few).sum())
                found.append(common / (len(a) + len(b) - common))
            keep = pa.array(np.array(found) >= threshold - 1e-12, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"]).filter(keep)

    return both.coalesce(parts).mapInArrow(run, "a long, b long, similarity double")


#: Grams are parted by their first seven bits.
PART_SHIFT = np.uint64(57)


def shared_grams(store: DataFrame, total: int, per_task: int = 500_000) -> DataFrame:
    """(node, core, parts): how many grams of each node some other node of ``store`` has too, and how many of them fall into each of 128 parts by their hash.

    ``total`` is the number of all grams. They are dealt out by hash, packed; each task first joins its
    own repeats, so a gram that all nodes share is a few entries. parts is null if a number is too
    large for a short.
    """
    tasks = max(1, -(-total // per_task))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            e, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(e, kind="stable")
            e, owner = e[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            alone = np.diff(np.concatenate([first, [len(e)]])) == 1
            e, owner = e[first], np.where(alone, owner[first], -1)
            task = (e % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(task, kind="stable")
            ends = np.searchsorted(task[order], np.arange(tasks + 1))
            cut = [order[ends[k] : ends[k + 1]] for k in range(tasks) if ends[k] < ends[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([int(task[x[0]]) for x in cut], pa.int64()), pa.array([e[x].tobytes() for x in cut], pa.binary()), pa.array([owner[x].tobytes() for x in cut], pa.binary())], names=["task", "e", "owner"])

        size = 0
        for batch in batches:
            for node, g in zip(batch.column("node").to_pylist(), batch.column("grams"), strict=True):
                e = np.frombuffer(g.as_buffer(), np.uint64)
                held.append((e, np.full(len(e), node, np.int64)))
                size += len(e)
                if size > per_task:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def find(packed: pa.Table) -> pa.Table:
        """The parts of each node's grams that it alone has, a byte for each gram."""
        e = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in packed.column("e")])
        owner = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in packed.column("owner")])
        order = np.argsort(e, kind="stable")
        e, owner = e[order], owner[order]
        same = e[1:] == e[:-1]
        alone = np.flatnonzero(~np.concatenate([[False], same]) & ~np.concatenate([same, [False]]) & (owner >= 0))
        alone = alone[np.argsort(owner[alone], kind="stable")]
        node, at = np.unique(owner[alone], return_index=True)
        lone = np.split((e[alone] >> PART_SHIFT).astype(np.uint8), at[1:])
        return pa.table({"node": node, "lone": pa.array([x.tobytes() for x in lone[: len(node)]], pa.binary())})

    def subtract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core, parts = [], []
            for g, lone in zip(batch.column("grams"), batch.column("lone").to_pylist(), strict=True):
                count = np.bincount((np.frombuffer(g.as_buffer(), np.uint64) >> PART_SHIFT).astype(np.int64), minlength=128)
                count -= np.bincount(np.frombuffer(b"".join(lone or ()), np.uint8), minlength=128)
                core.append(int(count.sum()))
                parts.append(count.astype(np.int16) if count.max() < 2**15 else None)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(core, pa.int64()), pa.array(parts, pa.list_(pa.int16()))], names=["node", "core", "parts"])

    lone = store.mapInArrow(deal, "task long, e binary, owner binary").groupBy("task").applyInArrow(find, "node long, lone binary")
    both = store.join(lone.groupBy("node").agg(F.collect_list("lone").alias("lone")), "node", "left")
    return both.select("node", "grams", "lone").mapInArrow(subtract, "node long, core long, parts array<short>")


def components(edges: DataFrame, edges_per_task: int = 100_000) -> DataFrame:
    """(node, label) for the nodes of an undirected graph; the label is the least node of the component.

    Alternates large-star and small-star until nothing changes; a node with very many neighbours is
    spread by ``attach_by_key``.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        far = attach_by_key(both, least, "u", "n", F.col("v"))
        out = far.where(F.col("v") > F.col("u") if large else F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.where("u > m").select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a > b").distinct()

    now = stable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    parts = max(1, now.count() // edges_per_task)
    kept = lambda df: stable(df.coalesce(parts))  # noqa: E731  few edges need few tasks
    while True:
        new = kept(star(kept(star(now, True)), False))
        summary = [x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (now, new)]
        if summary[0] == summary[1]:
            break
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def reaches(common: Column, a: Column, b: Column, threshold: float) -> Column:
    """Whether two multisets of those sizes with so much in common are similar enough."""
    return common >= threshold * (a + b - common) - 1e-9


def possible(a: Column, b: Column, threshold: float) -> Column:
    """Whether two nodes (structs with n_shingles, core and parts) can be similar enough.

    In each part by hash they have no more grams in common than the one with fewer shared grams there has.
    """
    most = F.aggregate(F.zip_with(a["parts"], b["parts"], lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    least = F.least(a["core"], b["core"])
    return reaches(least, a["n_shingles"], b["n_shingles"], threshold) & reaches(F.coalesce(most.cast("long"), least), a["n_shingles"], b["n_shingles"], threshold)


def tasks(rows: int, rows_per_task: int = 50_000) -> int:
    """How many tasks so many short rows need: more would be many small files."""
    return max(1, rows // rows_per_task)


def mixed_groups(held: DataFrame, labels: DataFrame, few: int) -> DataFrame:
    """The rows of ``held`` (band, node, n_shingles and more) of groups whose nodes are in different components, with label, and of the group: n, rest, main, least_n.

    main is the label of its largest component, rest the number of nodes outside it, least_n the smallest n_shingles.
    """
    own = held.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = own.groupBy("band", "label").agg(F.count("*").alias("n"), F.min("n_shingles").alias("least_n"))
    groups = parts.groupBy("band").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.min("least_n").alias("least_n"))
    groups = stable(groups.where(F.col("most.n") < F.col("n")).select("band", "n", (F.col("n") - F.col("most.n")).alias("rest"), F.col("most.label").alias("main"), "least_n").coalesce(few))
    return stable(attach_by_key(own, groups, "band", "n", F.col("node")).coalesce(few))


def link(rows: DataFrame, nodes: DataFrame, n: int, threshold: float, leaders: int = 4, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(node, label) of the nodes that have a link, and verified links (a, b, similarity) that connect each class.

    Candidates are the pairs of nodes that share a band. Their links are found without making all
    pairs of a group:

    1. In each group the least node is compared with all others. That links most of what is alike.
    2. Only groups whose nodes are then in different components matter further. A node is left out of
       such a group if its grams that no other node of these groups has leave too few for any link.
    3. In each group that is still mixed, ``leaders`` nodes that have the fewest grams of their own (one of
       each part of the group by a hash) are compared with the nodes of other components. A copy that
       was changed little is near to most copies, so that nearly all links of a large group of copies
       are found by few comparisons.
    4. In groups that are mixed even then, the nodes outside the largest component are a query set
       against all nodes of other components, in blocks of ``block`` nodes: only pairs that their
       sizes and numbers of shared grams, whole and in 128 parts, let be similar enough are made.

    So every pair of a group ends compared, in one component already, or ruled out by a bound that holds.
    """
    spread = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    groups = spread.groupBy("band").agg(F.min(F.struct("node", "n_shingles")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    groups = stable(groups.coalesce(tasks(nodes.count())))
    few = tasks(groups.agg(F.sum("n")).first()[0] or 0)  # what follows has a row for each node and group at most
    held = stable(attach_by_key(spread, groups, "band", "n", F.col("node")).coalesce(few))
    store = tested = links = labels = None

    def compare(pairs: DataFrame) -> None:
        """Adds the links among pairs (x, y) of nodes that weren't compared yet."""
        nonlocal store, tested, links, labels
        pairs = pairs.select(F.least("x", "y").alias("b"), F.greatest("x", "y").alias("a")).distinct()
        pairs = stable((pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")).coalesce(few))
        need(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
        found = stable(verified(pairs.select(F.col("a").alias("b"), F.col("b").alias("a")), store, threshold))
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        old = None if labels is None else labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = stable(components(found.select("a", "b") if old is None else old.unionByName(found.select("a", "b"))))

    def need(wanted: DataFrame) -> None:
        """Reads the texts of nodes whose grams aren't stored yet."""
        nonlocal store
        wanted = wanted.distinct()
        missing = stable((wanted if store is None else wanted.join(store.select("node"), "node", "left_anti")).join(nodes.select("node", "row"), "node").coalesce(few))
        if store is None or not missing.isEmpty():
            new = stable(grams(rows, missing, n))
            store = new if store is None else store.unionByName(new)

    compare(held.where((F.col("node") != F.col("lead.node")) & (F.least("n_shingles", "lead.n_shingles") >= threshold * F.greatest("n_shingles", "lead.n_shingles") - 1e-9)).select(F.col("lead.node").alias("x"), F.col("node").alias("y")))
    inside = mixed_groups(held.select("band", "node", "n_shingles"), labels, few)
    if inside.isEmpty():
        return labels, links
    some = stable(inside.select("node", "n_shingles").distinct().coalesce(few))
    need(some.select("node"))
    cores = stable(shared_grams(store.join(small(some.select("node")), "node", "left_semi"), some.agg(F.sum("n_shingles")).first()[0]))
    able = reaches(F.col("core"), F.col("n_shingles"), F.greatest("least_n", "core"), threshold)
    held = stable(inside.join(cores, "node").where(able).select("band", "node", "n_shingles", "core", "parts").coalesce(few))
    me = F.struct("node", "label", "n_shingles", "core", "parts")

    inside = mixed_groups(held, labels, few)
    central = F.min_by(me, F.struct(F.col("n_shingles") - F.col("core"), F.col("node"))).alias("lead")
    chosen = inside.groupBy("band", F.pmod(F.xxhash64("node"), F.lit(leaders)).alias("part")).agg(central, F.first("n").alias("n"))
    chosen = stable(chosen.groupBy("band").agg(F.first("n").alias("n"), F.collect_list("lead").alias("leads")).coalesce(few))
    faced = attach_by_key(inside.drop("n"), chosen, "band", "n", F.col("node")).select(me.alias("me"), F.explode(F.expr("filter(leads, x -> x.label != label)")).alias("lead"))
    compare(faced.where(possible(F.col("me"), F.col("lead"), threshold)).select(F.col("me.node").alias("x"), F.col("lead.node").alias("y")))

    inside = mixed_groups(held, labels, few)
    blocks, asking = (F.ceil(F.col(c) / block) for c in ("n", "rest"))
    members = inside.select("band", F.pmod(F.xxhash64("node"), blocks).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), asking - 1)).alias("i"), me.alias("y"))
    asked = inside.where(F.col("label") != F.col("main")).select("band", F.pmod(F.xxhash64("node"), asking).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("j"), me.alias("x"))
    compare(asked.join(members, ["band", "i", "j"]).where((F.col("x.label") != F.col("y.label")) & possible(F.col("x"), F.col("y"), threshold)).select("x.node", F.col("y.node").alias("other")).toDF("x", "y"))
    return labels, links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, bands: int = 25, rows: int = 5) -> DataFrame:
    """The class of near-duplicates of every row: connected by links of similarity ``threshold`` or more.

    The bag of a text is the multiset of its runs of ``words`` words (a shorter text is one run). Equal
    bags are one node, so copies are never expanded into pairs. A link is a pair of nodes whose
    BagMinHash signatures share a band and whose bags have that weighted Jaccard similarity. With 25
    bands of 5 slots a pair at 0.8 shares no band with probability 5e-5, at 0.9 with 1e-10.

    Returns row (the place in the input, see ``keyed``), the id, class_id (least id of the class),
    class_size, n_shingles, kept (true for one row of each class: the one with the least id), and one
    verified link of each row: link_id (for a copy the first row of its bag; for that row the most
    similar other one it is linked to; null in a class of one) and similarity.

    Defined cases: a null text counts as empty; a text without words is a class of its own; a very long
    text is one row of whole grams like any other (some 8 bytes a word); a null id counts as larger
    than any other; of rows with the same least id one is kept, by place; an empty table gives no rows;
    other input columns, whatever their names, are ignored. Texts aren't copied if ``docs`` is a plain
    table of files.
    """
    return classes_of(keyed(docs, {id_col: "id", text_col: "text"}), words, threshold, bands, rows).withColumnRenamed("id", id_col)


def classes_of(numbered_rows: DataFrame, words: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """``near_dedup`` of a numbered table (row, id, text)."""
    signed = stable(sign(numbered_rows, words, bands * rows, rows))
    best = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    some = signed.where("bag is not null")
    nodes = some.groupBy("bag").agg(F.min(best).alias("best"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), F.col("best.row").alias("row"), "*")
    nodes = stable(nodes.coalesce(tasks(signed.count(), 10_000)))
    labels, links = link(numbered_rows, nodes, words, threshold)
    named = nodes.drop("bands", "row", "n_shingles").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    few = tasks(nodes.count(), 10_000)
    classes = stable(named.groupBy("label").agg(F.min("best").alias("first"), F.sum("copies").alias("class_size"), F.count("*").alias("members")).coalesce(few))
    # of each node its most similar link, and who that is
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("to"), "similarity").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to"), "similarity"))
    closest = stable(ends.groupBy("node").agg(F.max(F.struct("similarity", (-F.col("to")).alias("to"))).alias("x")).select("node", (-F.col("x.to")).alias("to"), "x.similarity").coalesce(few))
    sizes = stable(closest.groupBy("to").agg(F.count("*").alias("linked")).coalesce(few))
    partners = attach_by_key(closest, sizes.join(nodes.select(F.col("node").alias("to"), F.col("best.id").alias("link_id")), "to"), "to", "linked", F.col("node"), sizes)
    full = attach_by_key(named, classes, "label", "members", F.col("node")).join(partners.select("node", "link_id", "similarity"), "node", "left")
    known = stable(full.select("bag", "copies", "first", "class_size", "best", "link_id", "similarity").coalesce(few))
    own = attach_by_key(some, known, "bag", "copies", F.xxhash64("row"))
    copy = F.col("row") != F.col("best.row")
    out = own.select("row", "id", F.col("first.id").alias("class_id"), "class_size", "n_shingles", (F.col("row") == F.col("first.row")).alias("kept"), F.when(copy, F.col("best.id")).otherwise(F.col("link_id")).alias("link_id"), F.when(copy, 1.0).otherwise(F.col("similarity")).alias("similarity"))
    kind = numbered_rows.schema["id"].dataType
    none = signed.where("bag is null").select("row", "id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "n_shingles", F.lit(True).alias("kept"), F.lit(None).cast(kind).alias("link_id"), F.lit(None).cast("double").alias("similarity"))
    return out.unionByName(none)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, bands: int = 25, rows: int = 5) -> DataFrame:
    """The rows that ``near_dedup`` keeps, with all columns unchanged. Texts shuffle only if the rows that go are too many to broadcast."""
    names = {id_col: "id", text_col: "text"}
    names |= {c: f"c{k}" for k, c in enumerate(c for c in docs.columns if c not in names)}
    all_rows = keyed(docs, names)
    gone = stable(classes_of(all_rows, words, threshold, bands, rows).where(~F.col("kept")).select("row"))
    return all_rows.join(small(gone), "row", "left_anti").select(*(F.col(names[c]).alias(c) for c in docs.columns))
