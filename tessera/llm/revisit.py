"""Resolution of not-modified WARC revisit records, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attach_by_key, keyed, shuffle_parts, stable

#: Fields of a 304 response that replace those of the stored one (RFC 9110, 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no default port, `/` for an empty path; null for other texts."""
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda i: F.regexp_extract(url, whole, i)
    scheme = F.lower(part(1))
    port = F.when(scheme == "http", F.lit(":80")).when(scheme == "https", F.lit(":443")).when(scheme == "ftp", F.lit(":21"))
    host = F.lower(part(2))
    host = F.when(F.coalesce(host.endswith(port), F.lit(False)), F.regexp_replace(host, r":\d+$", "")).otherwise(host)
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    return F.when(url.rlike(whole), F.concat(scheme, F.lit("://"), host, path, part(4)))


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """Join every revisit record to the latest earlier full response of its canonical URL.

    ``records`` has record_id, url, kind (`response` or `revisit`), ts (long), headers (map of lower-case
    names) and digest (of the payload). Earlier means a smaller (ts, record_id). The response found is
    the base if no validator disagrees: an etag (without the weak mark), last-modified or digest that
    both have must be equal, and at least one must be there on both sides. The base's headers are then
    taken with those of the revisit that are ``permitted``.

    A URL may have a third of all records, and they may all be of one moment. Records are dealt out in
    ranges of equally many rows by (url, ts, record_id), so that a hot URL fills several ranges. Within
    a range a window finds the latest response; a second window over the last responses of a URL's
    ranges (one row for each) carries it into later ones. Only keys go through the windows. Headers are
    joined at the end; a response that is the base of very many revisits is spread.

    Returns one row for each revisit: record_id, url_key, ts, base_id, status (`resolved`,
    `validator_mismatch`, `no_validator`, `no_response`, `bad_url`), headers and digest of the resolved
    response (null unless resolved). Defined cases: a null or unusable URL is `bad_url`; a null ts or
    record_id sorts first; null headers are empty; very long URLs and headers are compared and joined
    whole; repeated rows are rows of their own: revisits with equal (ts, record_id) see only what is
    before them all, and of such responses the last by place (see ``keyed``) is the base; an empty table
    gives no rows; other kinds and extra columns are ignored.
    """
    some = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "kind", "ts", "digest", canonical_url(F.col("url")).alias("url_key"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    rows = keyed(some, {c: c for c in some.columns})
    usable = rows.where(F.col("url_key").isNotNull()).select("row", "url_key", "ts", "record_id", "kind")
    dealt = stable(usable.repartitionByRange(shuffle_parts(records.sparkSession), "url_key", "ts", "record_id").withColumn("__range", F.spark_partition_id()))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "row"))

    # peers with an equal (ts, record_id) don't see each other: a range frame over one ordering value
    place = dealt.withColumn("__rank", F.rank().over(Window.partitionBy("url_key", "__range").orderBy("ts", "record_id")))
    earlier = Window.partitionBy("url_key", "__range").orderBy("__rank").rangeBetween(Window.unboundedPreceding, -1)
    inside = place.withColumn("__near", F.max(full).over(earlier)).where(F.col("kind") == "revisit").select("row", "url_key", "__range", "__near")

    lasts = dealt.groupBy("url_key", "__range").agg(F.max(full).alias("__last"))
    after = Window.partitionBy("url_key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("url_key", "__range", F.max("__last").over(after).alias("__far"))
    base = stable(inside.join(carried, ["url_key", "__range"]).select("row", F.coalesce("__near", "__far")["row"].alias("base")))

    mine = rows.where(F.col("kind") == "revisit").select("row", "record_id", "url_key", "ts", F.col("headers").alias("__own"), F.col("digest").alias("__digest")).join(base, "row", "left")
    sizes = stable(base.where("base is not null").groupBy("base").agg(F.count("*").alias("__n")))
    theirs = rows.where(F.col("kind") == "response").select(F.col("row").alias("base"), F.struct("record_id", "headers", "digest").alias("__base"))
    found = attach_by_key(mine.where("base is not null"), sizes.join(theirs, "base"), "base", "__n", F.col("row"), sizes)
    none = mine.where("base is null").withColumn("__base", F.lit(None).cast(theirs.schema["__base"].dataType))
    every = found.select("record_id", "url_key", "ts", "__own", "__digest", "__base").unionByName(none.select("record_id", "url_key", "ts", "__own", "__digest", "__base"))

    clean = lambda c: F.regexp_replace(c, "^W/", "")
    own, head = F.col("__own"), F.col("__base.headers")
    both = [(clean(own["etag"]), clean(head["etag"])), (own["last-modified"], head["last-modified"]), (F.col("__digest"), F.col("__base.digest"))]
    differ, alike = F.lit(False), F.lit(False)
    for a, b in both:
        differ = differ | F.coalesce(a != b, F.lit(False))
        alike = alike | (a.isNotNull() & b.isNotNull())
    status = F.when(F.col("url_key").isNull(), "bad_url").when(F.col("__base").isNull(), "no_response").when(differ, "validator_mismatch").when(alike, "resolved").otherwise("no_validator")
    new = F.map_filter(own, lambda k, _: k.isin(*permitted))
    merged = F.map_concat(F.map_filter(head, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    done = every.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return done.select("record_id", "url_key", "ts", F.col("__base.record_id").alias("base_id"), "status", F.when(ok, merged).alias("headers"), F.when(ok, F.col("__base.digest")).alias("digest"))
