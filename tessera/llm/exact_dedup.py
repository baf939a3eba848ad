"""Exact deduplication by two-pass Bloom filtering, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, keyed, small, stable

#: Bits in one value of bitmap_construct_agg.
PAGE = 32768
OWN = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _positions(bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64("text_sha256", F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def repeated_filter(keys: DataFrame, bits: int) -> DataFrame:
    """First pass: the Bloom filter of positions that at least two rows set, as pages (page, bitmap).

    A key that two rows share has both of its positions in it. Counts are summed on the map side, so
    that a hot key sends one row from each task.
    """
    counts = keys.select(F.explode(F.array(*_positions(bits))).alias("pos")).groupBy("pos").agg(F.count("*").alias("n"))
    twice = counts.where("n > 1").select((F.col("pos") / PAGE).cast("int").alias("page"), (F.col("pos") % PAGE).alias("bit"))
    return twice.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _probe(rows: DataFrame, pages: DataFrame, pos: Column, name: str) -> DataFrame:
    page = F.broadcast(pages.select(F.col("page").alias("__page"), F.col("bitmap").alias("__bitmap")))
    bit = (pos % PAGE).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    out = rows.join(page, (pos / PAGE).cast("int") == F.col("__page"), "left")
    return out.withColumn(name, hit).drop("__page", "__bitmap")


def _maybe(rows: DataFrame, keys: DataFrame, bits: int) -> tuple[DataFrame, Column]:
    """``rows`` tested against the filter of ``keys``, and the condition that a row may be repeated."""
    pages = stable(repeated_filter(keys, bits))
    first, second = _positions(bits)
    return _probe(_probe(rows, pages, first, "__a"), pages, second, "__b"), F.col("__a") & F.col("__b")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, bits_per_row: int = 16, max_filter_bits: int = 1 << 28) -> DataFrame:
    """Mark, for every row, which of the rows with an equal text stays.

    Texts are equal when they are identical after each run of ASCII white space became one space; a
    null text counts as empty. Pass 1 sets two positions per row in a Bloom filter and keeps those set
    twice; pass 2 tests all rows against it. A row outside it is certainly unique and passes straight
    through; only the others shuffle, to be grouped by SHA-256. The filter has ``bits_per_row`` bits a
    row. ``max_filter_bits`` (32 MB) bounds what is broadcast at once: more rows (some 17 million) are
    treated in slices of the hash space, one after another, each with a filter of its own, over the
    stored hashes; what they find is then joined to the rows by their place.

    Returns the columns ``carry`` (default: all; columns with a name of the result are replaced) and
    keep_id, group_size, kept, text_sha256. Defined cases: a null id counts as larger than any other;
    of repeated rows with equal id and text the first by place (see ``keyed``) is kept; a very long text
    is hashed whole; an empty table gives no rows.
    """
    names = {c: f"__in{k}" for k, c in enumerate(c for c in (df.columns if carry is None else carry) if c not in OWN)}
    light = text_col not in names
    needed = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    if light:  # numbers that must be stored are stored with the hash instead of the text
        needed = needed.select("*", F.sha2(normalised(F.col("__text")), 256).alias("text_sha256")).drop("__text")
    rows = keyed(needed, {c: c for c in needed.columns})
    own = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), "row")
    base = rows.select(own.alias("__own"), *names.values(), F.col("text_sha256") if light else F.sha2(normalised(F.col("__text")), 256).alias("text_sha256"))
    base = stable(base) if light else base
    total = base.count()
    slices = max(1, -(-total * bits_per_row // max(PAGE, max_filter_bits)))
    bits = PAGE
    while bits < total * bits_per_row / slices:
        bits *= 2
    out = [*(F.col(n).alias(c) for c, n in names.items()), "keep_id", "group_size", "kept", "text_sha256"]

    def grouped(shared: DataFrame) -> DataFrame:
        groups = stable(shared.groupBy("text_sha256").agg(F.min("__own").alias("__best"), F.count("*").alias("group_size")))
        joined = attach_by_key(shared, groups, "text_sha256", "group_size", F.col("__own"))
        return joined.withColumn("keep_id", F.col("__best.id")).withColumn("kept", F.col("__own") == F.col("__best"))

    if slices == 1:
        tested, maybe = _maybe(base, base.select("text_sha256"), bits)
        single = tested.where(~maybe).select("*", F.col("__own.id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        return single.select(*out).unionByName(grouped(tested.where(maybe)).select(*out))
    keys, found = base if light else stable(base.select("__own", "text_sha256")), None
    for k in range(slices):
        part = keys.where(F.pmod(F.xxhash64("text_sha256", F.lit(3)), F.lit(slices)) == k).select("__own", "text_sha256")
        tested, maybe = _maybe(part, part.select("text_sha256"), bits)
        shared = stable(tested.where(maybe).select("__own", "text_sha256"))
        found = shared if found is None else found.unionByName(shared)
    marked = stable(grouped(found).select(F.col("__own.row").alias("__row"), "keep_id", "group_size", "kept"))
    joined = base.withColumn("__row", F.col("__own.row")).join(small(marked), "__row", "left")
    return joined.withColumns({"keep_id": F.when(F.col("kept").isNull(), F.col("__own.id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long")), "kept": F.coalesce("kept", F.lit(True))}).select(*out)
