"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe
from .common import crc_mod, table
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .language_id import language_id
from .near_dedup import near_dedup
from .quality import quality_scores
from .revisit import resolve_revisits
from .sharding import shard_by_bytes
from .substring_dedup import substring_dedup
from .token_counts import token_counts


def warc_records(pages: DataFrame) -> DataFrame:
    """Captures as records, made from pages: each page is a full response at one time and not modified at a later one.

    Ten pages make a period of a site section, so that the URLs of a host and language meet; every
    seventh revisit has another etag, every eleventh has no validator and every thirteenth comes first.
    """
    url = F.regexp_replace("url", r"/\d+([^/]*)$", "/")
    etag = F.concat(F.lit('"'), F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16), F.lit('"'))
    day = F.col("page_id") * 100
    response = pages.select((F.col("page_id") * 2).alias("record_id"), url.alias("url"), F.lit("response").alias("kind"), day.alias("ts"), F.create_map(F.lit("etag"), etag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), day.cast("string")).alias("headers"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    seen = F.when(F.col("page_id") % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), etag))
    later = F.when(F.col("page_id") % 13 == 0, day - 1).otherwise(day + 50)
    headers = F.when(F.col("page_id") % 11 == 0, F.create_map(F.lit("date"), later.cast("string"), F.lit("content-length"), F.lit("0"))).otherwise(F.create_map(F.lit("etag"), seen, F.lit("date"), later.cast("string"), F.lit("content-length"), F.lit("0")))
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), url.alias("url"), F.lit("revisit").alias("kind"), later.alias("ts"), headers.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return response.unionByName(revisit)


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(warc_records(table(spark, sf_dir, "pages")))
    return found.select("record_id", "url_key", "ts", "base_id", "status", F.col("headers")["etag"].alias("etag"), F.col("headers")["date"].alias("date"), F.col("headers")["content-type"].alias("content_type"), F.size(F.map_keys("headers")).alias("n_headers"), "digest")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id(docs, learn=crc_mod(F.col("doc_id"), 5) != 0, carry=["doc_id"])
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "bits_per_symbol")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op4_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), model_path or public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=crc_mod(F.col("doc_id"), 3) != 1)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_key")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, carry=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_shingles", "kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisit": op1_warc_revisit,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_near_dedup": op9_near_dedup,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL = {
    "op1_warc_revisit": r"""
        WITH p AS (SELECT page_id, regexp_replace(url, '/\d+([^/]*)$', '/') AS url, sha256(coalesce(html, '')) AS digest FROM pages),
        c AS (SELECT page_id, digest, '"' || substr(digest, 1, 16) || '"' AS etag, page_id * 100 AS day,
                     CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
                       lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' ||
                       regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), CASE WHEN lower(url) LIKE 'http:%' THEN ':80$' WHEN lower(url) LIKE 'https:%' THEN ':443$' ELSE ':21$' END, '') ||
                       coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') ||
                       regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) END AS url_key
              FROM p),
        r AS (SELECT page_id * 2 AS record_id, url_key, day AS ts, etag, digest, CAST(day AS VARCHAR) AS date FROM c),
        v AS (SELECT page_id * 2 + 1 AS record_id, url_key, CASE WHEN page_id % 13 = 0 THEN day - 1 ELSE day + 50 END AS ts,
                     CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"other"' ELSE 'W/' || etag END AS etag FROM c),
        j AS (SELECT v.*, max_by(struct_pack(record_id := r.record_id, etag := r.etag, digest := r.digest), [r.ts, r.record_id]) AS b
              FROM v LEFT JOIN r ON r.url_key = v.url_key AND (r.ts < v.ts OR r.ts = v.ts AND r.record_id < v.record_id)
              GROUP BY v.record_id, v.url_key, v.ts, v.etag),
        s AS (SELECT *, CASE WHEN url_key IS NULL THEN 'bad_url' WHEN b.record_id IS NULL THEN 'no_response' WHEN regexp_replace(etag, '^W/', '') <> b.etag THEN 'validator_mismatch'
                             WHEN etag IS NOT NULL THEN 'resolved' ELSE 'no_validator' END AS status FROM j)
        SELECT record_id, url_key, ts, b.record_id AS base_id, status, CASE WHEN status = 'resolved' THEN etag END AS etag,
               CASE WHEN status = 'resolved' THEN CAST(ts AS VARCHAR) END AS date, CASE WHEN status = 'resolved' THEN 'text/html' END AS content_type,
               CASE WHEN status = 'resolved' THEN 3 END AS n_headers, CASE WHEN status = 'resolved' THEN b.digest END AS digest
        FROM s""",
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        v AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth
              FROM (SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS k
                    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d))),
        r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM v WHERE nth > 1),
        p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
        k AS (SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.pos) AS kept
              FROM p ANTI JOIN r ON r.doc_id = p.doc_id AND r.pos = p.pos GROUP BY p.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op10_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                   FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + 9], ' ') AS k
              FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
        o AS (SELECT DISTINCT x.doc_id, x.i, x.m, p.item_id
              FROM (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS k
                    FROM (SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM d, (SELECT DISTINCT m FROM p))) x
              JOIN p ON p.k = x.k AND p.m = x.m),
        h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM o) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
