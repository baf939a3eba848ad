"""Queries over votes, requests and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import anchor
from .functions.price import approximate_minor, minor_units, rescale
from .operators.quorum import Observation, latest_votes, reconcile, upper_median
from .operators.ratelimit import waits
from .operators.retail import availability
from .operators.trust import ARTIFACTS, accepts_peer, admit, is_anchored, requires_peers, tier_of
from .schemas import QuorumParams


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts) -> Column:
    """Seconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_date(t.cast("date")).cast("long") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60 + F.floor(F.second(t)).cast("long")


def _line_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("observer"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("qty"), epoch("l_shipdate").alias("at"))


def _event_votes(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select((F.floor(epoch("ts") / size) * size).cast("long").alias("slot"), F.col("user_id").alias("observer"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("qty"), epoch("ts").alias("at"))


def quorum_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _line_votes(spark, sf_dir)
    return reconcile(votes, ["part"], Observation(F.col("flag"), F.col("at"), F.col("qty")), 2_000_000_000, QuorumParams(3, 2_000_000_000, 5))


def quorum_retail_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _event_votes(spark, sf_dir, 86_400)
    return reconcile(votes, ["slot"], Observation(F.col("kind"), F.col("at"), F.col("qty")), F.col("slot") + 86_400, QuorumParams(3, 21_600, 20))


def quorum_ties_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _event_votes(spark, sf_dir, 3_600)
    return reconcile(votes, ["slot"], Observation(F.col("kind"), F.col("at")), F.col("slot") + 3_600, QuorumParams(1, 3_600, 0)).drop("quantity")


def quorum_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hashed = F.when(F.col("doc_id") % 11 == 0, F.lit("00" * 32)).otherwise(F.sha2("text", 256))
    votes = docs.select(F.col("source").alias("url"), F.unhex(hashed).alias("hash"), (F.col("doc_id") % 97).alias("observer"), F.col("doc_id").alias("seq"), F.lit(0).cast("long").alias("at"))
    out = reconcile(votes, ["url"], Observation(F.col("hash"), F.col("at"), admissible=anchor(F.col("hash")).isNotNull()), 0, QuorumParams(1, 3_600, 2))
    return out.select("url", F.lower(F.hex("claim")).alias("sha256"), "support", "dissent")


def latest_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _event_votes(spark, sf_dir, 86_400)
    return latest_votes(votes, ["slot"], at="at").select("slot", "observer", "kind", "qty", "at", "seq")


def upper_median_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("long"))).alias("qs"))
    return rows.select("l_partkey", upper_median("qs", 3, 10).alias("median"))


def rate_limit_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("host"), epoch("ts").alias("now"), (F.col("event_id") % 5 * 900).alias("extra"))
    return waits(rows, 600, extra=F.col("extra"), order=["event_id"]).select("event_id", "host", "now", "wait_secs")


def price_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = F.concat(F.floor("p_retailprice").cast("string"), F.when(k % 7 == 0, F.lit("")).when(k % 7 == 1, F.lit(".")).otherwise(F.concat(F.lit("."), F.lpad((k * 37 % 10_000).cast("string"), 4, "0"))))
    text = F.when(k % 13 == 0, F.concat(F.lit("$"), text)).when(k % 13 == 1, F.concat(F.lit("-"), text)).otherwise(text)
    code = F.element_at(F.array(*map(F.lit, ("USD", "jpy", "KWD", "EUR"))), (k % 4 + 1).cast("int"))
    table_of = {"JPY": 0, "KWD": 3}
    return rows.select(F.col("p_partkey"), minor_units(text, "major_decimal", code, table_of).alias("exact"), minor_units(text, "minor_int", code, table_of).alias("whole"), approximate_minor(text).alias("approximate"), rescale((k * 137).cast("long"), F.lit(3), (k % 5).cast("int")).alias("rescaled"))


def availability_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ("https://schema.org/InStock", "in stock", "http://schema.org/OutOfStock", "sold out", "PreOrder", "https://schema.org/LimitedAvailability", "maybe", "OnlineOnly", "Back-Order", "")
    rows = table(spark, sf_dir, "part")
    text = F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    return rows.select("p_partkey", text.alias("raw"), availability(text).alias("availability"))


def trust_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = sorted(ARTIFACTS)
    docs = table(spark, sf_dir, "documents")
    hashed = F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("00" * 32))).otherwise(F.unhex(F.sha2("text", 256)))
    rows = docs.select("doc_id", F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % len(kinds) + 1).cast("int")).alias("kind"), hashed.alias("source_hash"))
    out = None
    for kind in kinds:
        part = admit(rows.where(F.col("kind") == kind), kind)
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "kind", tier_of(F.col("kind")).alias("tier"), requires_peers(F.col("kind")).alias("requires_peers"), accepts_peer(F.col("kind")).alias("accepts_peer"), is_anchored(F.col("source_hash")).alias("anchored"))


QUERIES = {f.__name__: f for f in (quorum_retail, quorum_retail_window, quorum_ties_refused, quorum_web, latest_vote, upper_median_tolerance, rate_limit_wait, price_minor, availability_norm, trust_admission)}

LINE_VOTES = "SELECT l_partkey AS s, l_suppkey AS o, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS claim, CAST(l_quantity AS BIGINT) AS qty, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS at_s FROM lineitem"
EVENT_VOTES = "SELECT CAST(epoch(date_trunc('{unit}', ts)) AS BIGINT) AS s, user_id AS o, event_id AS seq, event_type AS claim, CAST(floor(value) AS BIGINT) AS qty, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM events"


def _quorum(votes: str, fresh: str, k: int, tolerance: int) -> str:
    return f"""
        WITH v AS ({votes}),
        l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, o ORDER BY at_s DESC, seq) AS rn FROM v WHERE {fresh}) WHERE rn = 1),
        t AS (SELECT s, claim, count(*) AS support, list_sort(list(qty) FILTER (qty IS NOT NULL)) AS q FROM l GROUP BY s, claim),
        m AS (SELECT *, max(support) OVER (PARTITION BY s) AS top, sum(support) OVER (PARTITION BY s) AS voters FROM t),
        w AS (SELECT *, count(*) OVER (PARTITION BY s) AS ties FROM m WHERE support = top),
        r AS (SELECT *, q[len(q) // 2 + 1] AS mid FROM w WHERE ties = 1 AND support >= {k})
        SELECT s, claim, CASE WHEN len(q) >= {k} AND len(list_filter(q, lambda x: abs(x - mid) <= {tolerance})) >= {k} THEN mid END AS quantity, support, CAST(voters - support AS BIGINT) AS dissent FROM r"""


ORACLE_SQL = {
    "quorum_retail": f"SELECT s AS part, claim, quantity, support, dissent FROM ({_quorum(LINE_VOTES, '2000000000 - at_s <= 2000000000', 3, 5)})",
    "quorum_retail_window": f"SELECT s AS slot, claim, quantity, support, dissent FROM ({_quorum(EVENT_VOTES.format(unit='day'), 's + 86400 - at_s <= 21600', 3, 20)})",
    "quorum_ties_refused": f"SELECT s AS slot, claim, support, dissent FROM ({_quorum(EVENT_VOTES.format(unit='hour'), 's + 3600 - at_s <= 3600', 1, 0)})",
    "quorum_web": f"SELECT s AS url, claim AS sha256, support, dissent FROM ({_quorum('SELECT source AS s, doc_id % 97 AS o, doc_id AS seq, sha256(text) AS claim, CAST(NULL AS BIGINT) AS qty, 0 AS at_s FROM documents WHERE doc_id % 11 <> 0', 'true', 1, 2)})",
    "latest_vote": f"SELECT s AS slot, o AS observer, claim AS kind, qty, at_s AS \"at\", seq FROM (SELECT *, row_number() OVER (PARTITION BY s, o ORDER BY at_s DESC, seq) AS rn FROM ({EVENT_VOTES.format(unit='day')})) WHERE rn = 1",
    "upper_median_tolerance": """
        SELECT l_partkey, CASE WHEN len(q) >= 3 AND len(list_filter(q, lambda x: abs(x - q[len(q) // 2 + 1]) <= 10)) >= 3 THEN q[len(q) // 2 + 1] END AS median
        FROM (SELECT l_partkey, list_sort(list(CAST(l_quantity AS BIGINT))) AS q FROM lineitem GROUP BY l_partkey)""",
    "rate_limit_wait": """
        SELECT event_id, event_type AS host, CAST(floor(epoch(ts)) AS BIGINT) AS now,
               CAST(greatest(coalesce(lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) + greatest(600, event_id % 5 * 900) - CAST(floor(epoch(ts)) AS BIGINT), 0), 0) AS BIGINT) AS wait_secs
        FROM events""",
    "price_minor": """
        WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN '$' WHEN p_partkey % 13 = 1 THEN '-' ELSE '' END || CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) ||
                          CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '.' ELSE '.' || lpad(CAST(p_partkey * 37 % 10000 AS VARCHAR), 4, '0') END AS x,
                          CASE p_partkey % 4 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 2 END AS e FROM part),
        d AS (SELECT k, e, CASE WHEN x NOT LIKE '$%' THEN CAST(rtrim(x, '.') AS DECIMAL(38, 4)) END AS v FROM t)
        SELECT k AS p_partkey, CAST(CASE e WHEN 0 THEN round(v, 0) WHEN 3 THEN round(v * 1000, 0) ELSE round(v * 100, 0) END AS BIGINT) AS exact, CAST(round(v, 0) AS BIGINT) AS whole,
               CAST(round(CAST(v AS DOUBLE) * 100) AS BIGINT) AS approximate,
               CAST(CASE k % 5 WHEN 4 THEN k * 1370 WHEN 3 THEN k * 137 WHEN 2 THEN (k * 137 + 5) // 10 WHEN 1 THEN (k * 137 + 50) // 100 ELSE (k * 137 + 500) // 1000 END AS BIGINT) AS rescaled
        FROM d""",
    "availability_norm": """
        WITH t AS (SELECT p_partkey, ['https://schema.org/InStock', 'in stock', 'http://schema.org/OutOfStock', 'sold out', 'PreOrder', 'https://schema.org/LimitedAvailability', 'maybe', 'OnlineOnly', 'Back-Order', ''][p_partkey % 10 + 1] AS raw FROM part)
        SELECT p_partkey, raw, CASE WHEN w IN ('instock', 'available', 'onlineonly', 'instoreonly') THEN 'in_stock' WHEN w IN ('outofstock', 'soldout', 'discontinued') THEN 'out_of_stock'
               WHEN w IN ('lowstock', 'limitedavailability', 'preorder', 'backorder', 'backordered', 'presale') THEN 'low_stock' ELSE 'unknown' END AS availability
        FROM (SELECT *, lower(regexp_replace(regexp_extract(raw, '[^/]*$'), '[^A-Za-z0-9]', '', 'g')) AS w FROM t)""",
    "trust_admission": """
        SELECT doc_id, kind, 'corroborable' AS tier, true AS requires_peers, true AS accepts_peer, doc_id % 5 <> 0 AS anchored
        FROM (SELECT doc_id, ['indexed_doc', 'retail_observation', 'vector', 'web_doc'][doc_id % 4 + 1] AS kind FROM documents)
        WHERE kind = 'retail_observation' OR kind <> 'vector' AND doc_id % 5 <> 0""",
}
