"""A polite HTTP source: pages of a table of URLs, and the reasons for those that couldn't be had."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sniff import body_within
from ..functions.urls import host_key, host_key_text, parse
from ..runtime import ship
from ..schemas import FetchConfig
from .robots import crawl_delay_secs, is_allowed


class FetchError(Exception):
    """A page that couldn't be fetched, with the reason."""


class BodyTooLarge(FetchError):
    """A body over the limit; it is never cut."""


def read_capped(read: Callable[[int], bytes], limit: int) -> bytes:
    """All bytes, if they are no more than the limit."""
    data = bytearray()
    while part := read(min(65_536, limit + 1 - len(data))):
        data += part
        if len(data) > limit:
            raise BodyTooLarge(f"body is over {limit} bytes")
    return bytes(data)


class RateLimiter:
    """The time of the last request to each host, as its caller's clock gave it."""

    def __init__(self, floor: int):
        self.floor = floor
        self.last: dict[str, int] = {}

    def wait_secs(self, host: str, now: int, extra: int | None = None) -> int:
        if host not in self.last:
            return 0
        return max(0, self.last[host] + max(self.floor, extra or 0) - now)

    def record(self, host: str, now: int) -> None:
        self.last[host] = now


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, limit: int):
        self.max_redirections = self.max_repeats = limit


def http_get(url: str, config: FetchConfig) -> tuple[int, str | None, bytes]:
    """Status, content type and body of one GET request."""
    opener = urllib.request.build_opener(_Redirects(config.max_redirects))
    request = urllib.request.Request(url, headers={"User-Agent": config.user_agent})
    try:
        with opener.open(request, timeout=config.timeout_secs) as r:
            return r.status, r.headers.get("content-type"), read_capped(r.read, config.max_body_bytes)
    except urllib.error.HTTPError as e:
        return e.code, None, b""
    except (OSError, ValueError) as e:
        raise FetchError(str(e)) from e


class Fetcher:
    """Fetches one page after another. Robots files are asked for once a host and kept; one that can't be had forbids nothing."""

    def __init__(self, config: FetchConfig = FetchConfig(), get=http_get, sleep=time.sleep):
        self.config, self.get, self.sleep = config, get, sleep
        self.limiter = RateLimiter(config.min_delay_secs)
        self.robots: dict[str, bytes | None] = {}

    def ensure_robots(self, url: str, host: str) -> None:
        if host in self.robots:
            return
        try:
            status, _, body = self.get(f"{urlsplit(url).scheme}://{host}/robots.txt", self.config)
            self.robots[host] = body if 200 <= status < 300 else None
        except FetchError:
            self.robots[host] = None

    def fetch(self, url: str, now: int) -> dict:
        if parse(url) is None:
            raise FetchError("not an absolute url")
        host = host_key_text(url)
        if host is None:
            raise FetchError("the url has no host")
        self.ensure_robots(url, host)
        body = self.robots[host]
        if not is_allowed(body, self.config.user_agent, url):
            raise FetchError("robots.txt forbids it")
        wait = self.limiter.wait_secs(host, now, crawl_delay_secs(body, self.config.user_agent))
        if wait:
            self.sleep(wait)
        self.limiter.record(host, now)  # the caller's time, also if the answer is an error
        status, kind, data = self.get(url, self.config)
        if not 200 <= status < 300:
            raise FetchError(f"status {status}")
        return {"url": url, "status": status, "content_type": kind, "body": data, "fetched_at": now}


def fetch_all(urls: DataFrame, config: FetchConfig = FetchConfig(), get=http_get, clock=time.time, partitions: int | None = None) -> DataFrame:
    """Pages (url, status, content_type, body, fetched_at, error) of a table of URLs, each host from one task only.

    Hosts are dealt out by hash, so one host's requests share a limiter and a robots file; polite delays
    make a host sequential anyway.
    """
    spark = urls.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = Fetcher(config, get)
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append({**fetcher.fetch(url, int(clock())), "error": None})
                except FetchError as e:
                    rows.append({"url": url, "status": None, "content_type": None, "body": None, "fetched_at": int(clock()), "error": str(e)})
            out = pd.DataFrame(rows, columns=["url", "status", "content_type", "body", "fetched_at", "error"])
            yield out.astype({"status": "Int32"})

    dealt = urls.select("url", host_key(F.col("url")).alias("host")).repartition(n, "host").select("url")
    return dealt.mapInPandas(run, "url string, status int, content_type string, body binary, fetched_at long, error string")


def replay(pages: DataFrame, max_body_bytes: int = FetchConfig.max_body_bytes) -> tuple[DataFrame, DataFrame]:
    """Stored pages as if fetched: those with a 2xx status and a body within the limit, and (url, extractor, reason) of the others."""
    ok = F.col("status").between(200, 299)
    small = body_within(F.col("body"), max_body_bytes)
    reason = F.when(~ok, F.concat(F.lit("status "), F.col("status").cast("string"))).when(~small, F.lit(f"body is over {max_body_bytes} bytes"))
    return pages.where(ok & small), pages.where(~(ok & small)).select("url", F.lit("fetch").alias("extractor"), reason.alias("reason"))
