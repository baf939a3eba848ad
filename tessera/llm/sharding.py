"""Shards of near-equal bytes by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attach_by_key, ship, stable


class Tree:
    """A balanced search tree (AVL) of different keys: insert, remove, and the least key from a given one on."""

    __slots__ = ("root",)

    def __init__(self):
        self.root: list | None = None  # key, left, right, height

    @staticmethod
    def _height(node: list | None) -> int:
        return node[3] if node else 0

    def _lift(self, node: list, side: int) -> list:
        """The child on ``side`` (1 left, 2 right) becomes the parent."""
        child = node[side]
        node[side], child[3 - side] = child[3 - side], node
        for x in (node, child):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return child

    def _level(self, node: list) -> list:
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        for side in (1, 2):
            child = node[side]
            if self._height(child) > self._height(node[3 - side]) + 1:
                if self._height(child[3 - side]) > self._height(child[side]):
                    node[side] = self._lift(child, 3 - side)
                return self._lift(node, side)
        return node

    def _insert(self, node: list | None, key) -> list:
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._insert(node[side], key)
        return self._level(node)

    def _remove(self, node: list, key) -> list | None:
        if key == node[0]:
            if not (node[1] and node[2]):
                return node[1] or node[2]
            least = node[2]
            while least[1]:
                least = least[1]
            node[0], key = least[0], least[0]
            node[2] = self._remove(node[2], key)
        else:
            side = 1 if key < node[0] else 2
            node[side] = self._remove(node[side], key)
        return self._level(node)

    def insert(self, key) -> None:
        self.root = self._insert(self.root, key)

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    def least_from(self, key):
        found, node = None, self.root
        while node:
            if node[0] >= key:
                found, node = node[0], node[1]
            else:
                node = node[2]
        return found


class Bins:
    """Open bins in a balanced tree by (remaining capacity, number); the tightest that fits is one search away."""

    def __init__(self, capacity: int, limit: int | None = None):
        self.capacity, self.limit = capacity, limit
        self.open = Tree()
        self.used: list[int] = []

    def place(self, size: int, count: int) -> list[tuple[int, int]] | None:
        """Best fit for ``count`` items of one size, as (bin, items); None if there is no bin left.

        The tightest bin that fits stays the tightest after an item went in, so it takes as many as it
        can hold before the next one is looked for.
        """
        out = []
        while count:
            tightest = self.open.least_from((size, -1))
            if tightest is None:
                if self.limit is not None and len(self.used) >= self.limit or size > self.capacity:
                    return None
                self.used.append(0)
                self.open.insert((self.capacity, len(self.used) - 1))
                continue
            rest, number = tightest
            self.open.remove(tightest)
            take = min(count, rest // size) if size else count
            self.used[number] += take * size
            self.open.insert((rest - take * size, number))
            out.append((number, take))
            count -= take
        return out


def pack(classes: Sequence[tuple[int, int]], capacity: int, limit: int | None = None) -> tuple[list[list[tuple[int, int]]], list[int]] | None:
    """Best-fit-decreasing for classes (size, items) in falling size: the bins of each class, and the bytes of each bin."""
    bins, plan = Bins(capacity, limit), []
    for size, count in classes:
        got = bins.place(size, count)
        if got is None:
            return None
        plan.append(got)
    return plan, bins.used


def smallest_capacity(classes: Sequence[tuple[int, int]], shards: int) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """The packing of the least capacity found that needs no more than ``shards`` bins.

    Starts at the mean load or the largest item, doubles what is added until it fits, then halves the step.
    """
    total = sum(s * n for s, n in classes)
    base = max([-(-total // shards), *(s for s, _ in classes[:1])]) if classes else 0
    low, extra, best = -1, 0, pack(classes, base, shards)
    while best is None:
        low, extra = extra, max(1, extra * 2)
        best = pack(classes, base + extra, shards)
    while extra - low > 1:
        middle = (low + extra) // 2
        got = pack(classes, base + middle, shards)
        if got is None:
            low = middle
        else:
            best, extra = got, middle
    return best


def near_equal(classes: Sequence[tuple[int, int]], shards: int, slack: float = 0.01) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """Bins of near-equal bytes: the bins of each class, and the bytes of each bin.

    An item larger than the mean of what is left gets a bin of its own. The rest is packed with the
    least capacity over the remaining bins. If that leaves a bin more than ``slack`` under their mean
    (few large items), only the fullest bin is settled, and what is left is packed anew.
    """
    plan: list[list[tuple[int, int]]] = [[] for _ in classes]
    left, used = [n for _, n in classes], []
    while any(left):
        open_classes = [k for k, n in enumerate(left) if n]
        room, total = shards - len(used), sum(classes[k][0] * left[k] for k in open_classes)
        if room > 1 and classes[open_classes[0]][0] * room > total:
            got, loads, settled = [[(0, 1)]], [classes[open_classes[0]][0]], [0]
        else:
            got, loads = smallest_capacity([(classes[k][0], left[k]) for k in open_classes], room)
            uneven = len(loads) < room or min(loads) * room < (1 - slack) * total
            settled = [loads.index(max(loads))] if uneven else range(len(loads))
        number = {b: len(used) + i for i, b in enumerate(settled)}
        used.extend(loads[b] for b in settled)
        for k, bins in zip(open_classes, got):  # noqa: B905  an item of its own has one class only
            taken = [(number[b], n) for b, n in bins if b in number]
            plan[k] += taken
            left[k] -= sum(n for _, n in taken)
    return plan, used


def numbered(rows: DataFrame, by: list[str], spread: str, order: list, buckets: int, name: str) -> DataFrame:
    """Gapless numbers from 0 within ``by``, without sorting a whole group in one task.

    Rows are dealt into ``buckets`` by the hash of ``spread``; sums of the buckets' counts (groups x
    buckets rows) give where each bucket's numbers start.
    """
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    counts = stable(dealt.groupBy(*by, "__b").agg(F.count("*").alias("__n")))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    within = Window.partitionBy(*by, "__b").orderBy(*order)
    got = dealt.withColumn("__k", F.row_number().over(within) - 1).join(starts, [*by, "__b"])
    return got.withColumn(name, (F.col("__from") + F.col("__k")).cast("long")).drop("__b", "__n", "__from", "__k")


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 50_000) -> DataFrame:
    """Put rows into ``shards`` shards of near-equal bytes; rows with equal texts stay together.

    The size of a row is the UTF-8 bytes of its text (a null text has none) plus 1; of a group, the sum.
    Groups of one size are alike, so the driver packs sizes with counts (their number follows the
    lengths of texts, not the rows), best fit by falling size; see ``near_equal``. The groups of a size
    are then numbered without gaps and take their bins in that order. A group larger than the mean of
    what is left has a shard of its own, and the others are spread over the remaining shards.

    Returns the id, size, text_crc32, group_key (SHA-256), group_size, shard, slot (gapless from 0 in
    each shard). Defined cases: null and empty texts are one group; a very long text is a group like any
    other; repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stable(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("group_key")))
    groups = rows.groupBy("group_key").agg(F.count("*").alias("copies"), F.sum("size").alias("group_size"))
    groups = stable(groups)
    classes = [(r["group_size"], r["n"]) for r in groups.groupBy("group_size").agg(F.count("*").alias("n")).collect()]
    classes.sort(reverse=True)
    plan, _ = near_equal(classes, shards)
    spans = []
    for (size, n), bins in zip(classes, plan, strict=True):
        at, own = 0, []
        for number, count in bins:
            own.append((at, at + count, number))
            at += count
        spans.append((size, n, own))
    total = sum(n for _, n in classes)
    buckets = max(1, -(-total // rows_per_bucket))
    where = stable(spark.createDataFrame(spans, "group_size long, groups long, spans array<struct<first:long,end:long,shard:int>>"))
    ranked = numbered(groups, ["group_size"], "group_key", ["group_key"], buckets, "nth")
    # a size may have very many groups, which are spread; it has at most one span for each shard
    found = attach_by_key(ranked, where, "group_size", "groups", F.col("group_key"))
    shard = F.filter("spans", lambda x: (F.col("nth") >= x["first"]) & (F.col("nth") < x["end"]))[0]["shard"]
    placed = found.select("group_key", "copies", "group_size", shard.alias("shard"))
    placed = attach_by_key(rows, stable(placed), "group_key", "copies", F.col("row"))
    slotted = numbered(placed, ["shard"], "row", ["id", "row"], max(1, -(-rows.count() // (shards * rows_per_bucket))), "slot")
    return slotted.select(F.col("id").alias(id_col), "size", "text_crc32", "group_key", "group_size", "shard", "slot")
