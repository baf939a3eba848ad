import pytest
from pyspark.sql import functions as F

from tessera.api import Client
from tessera.functions.hashing import embed_tokens, url_id
from tessera.operators import search, stats, trust
from tessera.operators.frontier import Frontier, modulo, newest_lists, owners
from tessera.operators.graph import Graph, min_pagerank, personalized_pagerank
from tessera.operators.query_syntax import BadQuery, Leaf, parse, words
from tessera.operators.ratelimit import waits
from tessera.operators.vectors_table import re_embed
from tessera.plans.pages import build, page_terms
from tessera.schemas import URL_ENTRY, EmbeddingSpace, default_node
from tessera.sources import robots
from tessera.sources.fetch import BodyTooLarge, Fetcher, FetchError, RateLimiter, fetch_all, read_capped, replay
from tessera.sources.tables import merge, open_table, pages_of


def urls_of(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_frontier(spark):
    lists = spark.createDataFrame([(["https://E.com/a#x", "https://e.com/a", "bad", "https://e.com:443/b"],)], "urls array<string>")
    f = Frontier.empty(spark).subscribe(lists)
    assert sorted(r["url"] for r in f.scan().collect()) == ["https://e.com/a", "https://e.com/b"]
    row = f.table.where("url = 'https://e.com/a'").withColumn("last_crawled", F.lit(90).cast("long"))
    f = Frontier(f.put(row).table.checkpoint())
    f = f.discover(urls_of(spark, "https://e.com/a", "https://e.com/c"))
    assert {r["url"]: r["last_crawled"] for r in f.scan().collect()} == {"https://e.com/a": 90, "https://e.com/b": None, "https://e.com/c": None}
    f = f.record(f.table.where("url = 'https://e.com/c'").withColumn("last_crawled", F.lit(10).cast("long")))
    assert [r["url"][-1] for r in f.due(100, 10).collect()] == ["b", "c", "a"]
    assert [r["url"][-1] for r in f.due(100, 2).collect()] == ["b", "c"] and f.due(100, 0).count() == 0
    assert f.get(f.table.limit(1)).count() == 1
    parts = [{r["url"] for r in Frontier(f.table, modulo(3, i)).due(100, 10).collect()} for i in range(3)]
    assert sum(map(len, parts)) == 3 == len(set().union(*parts))
    with pytest.raises(ValueError):
        modulo(3, 3)
    assert owners(f.table.select("id"), 4, copies=3).groupBy("id").agg(F.count_distinct("node").alias("n")).where("n <> 3").count() == 0
    assert f.to_embed("m@8/f32").count() == 2


def test_unchanged_and_lists(spark):
    rows = spark.createDataFrame([("u", b"1" * 32, 5, b"h" * 32, {}, [])], URL_ENTRY)
    fetched = spark.createDataFrame([(b"1" * 32, b"h" * 32), (b"1" * 32, b"g" * 32), (b"2" * 32, b"h" * 32)], "id binary, content_hash binary")
    assert Frontier(rows).unchanged(fetched).count() == 1
    lists = spark.createDataFrame([("a", 1, 5, "old"), ("a", 2, 1, "new"), ("b", 1, 1, "b")], "id string, version long, updated_at long, name string")
    assert sorted(r["name"] for r in newest_lists(lists).collect()) == ["b", "new"]


def test_graph(spark, tmp_path):
    g = Graph.empty(spark).add_edges(spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c")], "src string, dst string"))
    g = g.add_edges(spark.createDataFrame([("a", "b"), ("b", "x")], "src string, dst string"))
    assert [r["dst"] for r in g.neighbors("a").collect()] == ["b", "c"] and g.node_count() == 2
    g = g.set_edges(spark.createDataFrame([("a", "z", 0), ("a", "z", 1)], "src string, dst string, pos int"), spark.createDataFrame([("a",), ("empty",)], "src string"))
    assert [r["dst"] for r in g.neighbors("a").collect()] == ["z", "z"] and g.node_count() == 3
    g.save(str(tmp_path / "g"))
    assert Graph.load(spark, str(tmp_path / "g")).edges.exceptAll(g.edges).count() == 0
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    seed = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    rank = {r["node"]: r["rank"] for r in personalized_pagerank(edges, seed("a"), iterations=30).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank["a"] > rank["b"] > rank["c"] > 0
    low = {r["node"]: r["rank"] for r in min_pagerank(edges, [seed("a"), seed("c")], iterations=4).collect()}
    assert low["a"] == 0 and low["c"] > 0


def docs(spark, *rows):
    return spark.createDataFrame([(i.encode(), f"https://e.com/{i}", t, b[:20], [(0, b)]) for i, t, b in rows], "url_id binary, url string, title string, snippet string, chunks array<struct<ordinal:int,text:string>>")


def test_index(spark):
    index = search.Index(spark)
    space = EmbeddingSpace("hash", 16, "int8")
    assert space.id == "hash@16/int8"
    index.register_space(space)
    index.register_embedder(space.id)
    rows = docs(spark, ("1", "Rust search", "a search engine in rust"), ("2", "Bread", "flour water salt"), ("3", "Other", "rust on iron"))
    index.upsert(rows)
    hits = index.search("rust search", 5).collect()
    assert [h["url"][-1] for h in hits] == ["1", "3"] and hits[0]["score"] > hits[1]["score"]
    assert index.search(" ", 5).count() == 0 and index.search("rust", 0).count() == 0 and index.search("AND (", 5).count() == 0
    assert index.served_spaces() == []
    vectors = [(r["url_id"], [float(x) for x in embed_tokens([r["chunks"][0]["text"].lower().split()], 16)[0]]) for r in rows.collect()]
    index.upsert_vectors(space.id, spark.createDataFrame([(bytes(i), v) for i, v in vectors], "url_id binary, values array<float>"))
    assert index.served_spaces() == [space.id]
    both = index.search("flour water salt", 2, space.id).collect()
    assert both[0]["url"][-1] == "2" and len(both) == 2 and both[0]["score"] > index.search("flour water salt", 2).collect()[0]["score"]
    assert index.search("rust", 5, "unknown space").count() == 2
    index.upsert(docs(spark, ("1", "New", "nothing here")))
    assert [h["url"][-1] for h in index.search("rust", 5).collect()] == ["3"] and index.docs.count() == 3
    left = re_embed(rows, rows.limit(1).select("url_id"), lambda t: F.array(F.size(t).cast("float")))
    assert left.count() == 2


def test_binary_space_round_trip(spark):
    index = search.Index(spark)
    index.register_space(space := EmbeddingSpace("b", 10, "binary"))
    v = [1.0, -1.0, 0.0, -2.0, 3.0, -1.0, -1.0, -1.0, -1.0, 5.0]
    index.upsert_vectors(space.id, spark.createDataFrame([(b"x", v)], "url_id binary, values array<float>"))
    assert list(index.plain_vectors(space.id).collect()[0]["values"]) == [1.0 if x >= 0 else -1.0 for x in v]


def test_blend(spark):
    d = spark.createDataFrame([("i1", "u1", "t", "s"), ("i2", "u1", "t", "s"), ("i3", "u2", "t2", "s2"), ("i4", "u2", "t2", "s2")], "url_id string, url string, title string, snippet string")
    keyword = spark.createDataFrame([("u1", "t", "s", 0.1), ("u9", "t", "s", 0.2)], "url string, title string, snippet string, score double")
    near = spark.createDataFrame([("i1", 0.8), ("i2", 0.4), ("i3", 1.0), ("i4", 0.5), ("gone", 1.0)], "url_id string, score double")
    got = [(r["url"], round(r["score"], 6), r["title"]) for r in search.blend(keyword, near, d, 10).collect()]
    assert got == [("u1", 0.4, "t"), ("u9", 0.2, "t"), ("u2", 0.25, "t2")]
    hits = keyword.withColumn("score", F.col("score") * 2)
    merged, complete = search.merge_answers({"local": keyword, "peer": hits}, ["local", "peer", "indexer"], 1)
    assert [(r["url"], r["source"], r["rank"]) for r in merged.collect()] == [("u9", "peer", 1.0)] and not complete


def test_trust_and_stats(spark):
    rows = spark.createDataFrame([(1, bytes(32)), (2, b"h" * 32), (3, None), (4, bytes(31) + b"\1")], "n int, source_hash binary")
    assert sorted(r["n"] for r in trust.admit(rows, "web_doc").collect()) == [2, 4]
    assert trust.admit(rows, "vector").count() == 0 and trust.admit(rows, "retail_observation").count() == 4
    kinds = spark.createDataFrame([("vector",), ("web_doc",), ("?",)], "k string").select(trust.tier_of(F.col("k")), trust.accepts_peer(F.col("k")), trust.requires_peers(F.col("k"))).collect()
    assert [tuple(r) for r in kinds] == [("local_only", False, False), ("corroborable", True, True), (None, False, False)]
    assert trust.TIERS["recomputable"].accepts_peer_contribution and not trust.TIERS["recomputable"].requires_peers
    d = spark.createDataFrame([("u1", "Rust book", "s", 1.0), ("u2", "Bread", "s", 2.0)], "url string, title string, snippet string, base_score double")
    assert [(r["url"], r["score"], r["rank"]) for r in stats.simple_search(d, " RUST x ").collect()] == [("u1", 4.0, 0.9)]
    assert [r["url"] for r in stats.simple_search(d, "zzz").collect()] == ["u2", "u1"]
    assert default_node(b"n", b"l", "s", 5)["query_visibility"] == "terminating"


def test_waits(spark):
    rows = spark.createDataFrame([("a", 100, None), ("a", 101, None), ("a", 101, 9), ("a", 300, None), ("b", 101, 5)], "host string, now long, extra long")
    got = [r["wait_secs"] for r in waits(rows, 2, extra=F.col("extra"), order=["extra"]).orderBy("host", "now", F.col("extra").asc_nulls_first()).collect()]
    assert got == [0, 1, 9, 0, 0]
    limiter = RateLimiter(2)
    assert limiter.wait_secs("a", 5) == 0
    limiter.record("a", 5)
    assert [limiter.wait_secs("a", 5), limiter.wait_secs("a", 6, 10), limiter.wait_secs("a", 9), limiter.wait_secs("b", 5)] == [2, 9, 0, 0]


ROBOTS = b"User-Agent: MyBot\nDisallow: /private\nAllow: /private/ok\nCrawl-Delay: 2.2\n\nUser-Agent: *\nDisallow: /\n"


def test_robots():
    ask = lambda agent, path: robots.is_allowed(ROBOTS, agent, f"https://e.com{path}")
    assert [ask("MyBot/1.0", p) for p in ("/", "/private/x", "/private/ok/y", "/public")] == [True, False, True, True]
    assert not ask("Other", "/") and robots.is_allowed(b"\xff\xfe\x00", "x", "https://e.com/") and robots.is_allowed(None, "x", "https://e.com/")
    assert robots.crawl_delay_secs(ROBOTS, "mybot") == 3 and robots.crawl_delay_secs(ROBOTS, "other") is None
    assert not robots.is_allowed(b"User-agent: *\nDisallow: /*.pdf$", "x", "https://e.com/a/b.pdf") and robots.is_allowed(b"User-agent: *\nDisallow:", "x", "https://e.com/")


def fake_web():
    # made in a function, so that workers needn't import this module
    def fake(url, config):
        if url.endswith("/robots.txt"):
            if "down" in url:
                raise FetchError("down")
            return (200, None, ROBOTS) if "strict" in url else (404, None, b"")
        if "big" in url:
            raise BodyTooLarge("too large")
        return (500, None, b"") if "fail" in url else (200, "text/html", b"<p>hi</p>")

    return fake


def test_fetching(spark):
    fake = fake_web()
    slept = []
    f = Fetcher(get=fake, sleep=slept.append)
    assert f.fetch("https://e.com/a", 10)["body"] == b"<p>hi</p>"
    f.fetch("https://e.com/b", 11)
    assert slept == [1]
    for bad in ("https://strict.com/x", "https://e.com/fail", "nope", "mailto:a@b.c", "https://e.com/big"):
        with pytest.raises(FetchError):
            f.fetch(bad, 100)
    assert f.limiter.last["e.com"] == 100  # a failed answer still used its turn
    assert f.fetch("https://down.com/x", 1)["status"] == 200
    out = fetch_all(urls_of(spark, "https://e.com/a", "https://o.com/fail", "bad"), get=fake, clock=lambda: 7, partitions=2)
    assert sorted((r["url"], r["status"], r["error"] is None) for r in out.collect()) == [("bad", None, False), ("https://e.com/a", 200, True), ("https://o.com/fail", None, False)]
    data = [b"abc", b"de", b""]
    assert read_capped(lambda n: data.pop(0), 5) == b"abcde"
    with pytest.raises(BodyTooLarge):
        read_capped(lambda n: b"x" * n, 5)
    pages = spark.createDataFrame([("a", 200, b"12345"), ("b", 200, b"123456"), ("c", 404, b"")], "url string, status int, body binary")
    good, bad = replay(pages, 5)
    assert [r["url"] for r in good.collect()] == ["a"] and sorted(r["url"] for r in bad.collect()) == ["b", "c"]


def test_batch_from_pages_to_tables(spark, tmp_path):
    html = spark.createDataFrame([("https://e.com/", '<html><title>Home</title><body>rust search <a href="/b">b</a></body></html>'), ("https://e.com/b", "<html><body>bread</body></html>"), ("bad", "<html></html>")], "url string, html string")
    pages = pages_of(html)
    t = build(pages, Frontier.empty(spark), now=5)
    t.write(str(tmp_path / "i"))
    read = lambda name: spark.read.parquet(str(tmp_path / "i" / name))
    assert read("docs").count() == 2 and read("graph/edges").count() == 1 and read("rejects").count() == 1 and read("vectors").count() == 2
    assert [r["url"] for r in search.Index.load(spark, str(tmp_path / "i")).search("rust", 5).collect()] == ["https://e.com/"]
    assert {r["url"]: r["last_crawled"] for r in read("frontier").collect()} == {"https://e.com/": 5, "https://e.com/b": 5}
    again = build(pages, Frontier(read("frontier")), now=9)
    assert again.docs.count() == 0  # nothing changed
    assert page_terms(t.docs).count() == 2
    assert open_table(spark, str(tmp_path / "none"), URL_ENTRY).count() == 0 and open_table(spark, str(tmp_path / "i/frontier"), URL_ENTRY).count() == 2
    one = spark.createDataFrame([(1, "new")], "k int, v string")
    assert sorted(r["v"] for r in merge(spark.createDataFrame([(1, "old"), (2, "two")], "k int, v string"), one, "k").collect()) == ["new", "two"]
    assert urls_of(spark, "x").select(F.length(url_id(F.col("url")))).first()[0] == 32


def test_client(spark):
    index = search.Index(spark, docs(spark, ("1", "Rust", "rust book"), ("2", "Bread", "salt")))
    graph = Graph.empty(spark).add_edges(spark.createDataFrame([("a", "b")], "src string, dst string"))
    lists = spark.createDataFrame([("l", "Seeds", ["u", "v"])], "id string, name string, urls array<string>")
    client = Client("n", index, graph, lists, spark.createDataFrame([("p",), ("q",)], "node string"), started_at=5)
    assert [r["url"][-1] for r in client.search(" rust ").collect()] == ["1"]
    status = client.node_status(65)
    assert status["uptime_secs"] == 60 and status["extractors"] == ["web", "retail"] and status["peers_connected"] == 2
    assert status["subscribed_lists"] == [{"id": "l", "label": "Seeds", "url_count": 2}]
    total = client.stats().first()
    assert (total["docs"], total["edges"], total["spaces"], total["lists"], total["peers"], total["postings"]) == (2, 1, 0, 1, 2, 5)


ROWS = {"1": ("Red fox", "the red fox and the dog"), "2": ("Dog", "a red dog not a fox"), "3": ("Cat and mouse", "the cat or the fox red"), "4": ("Fox red", "red red")}


def matches(node, k):
    """Whether document k matches a parsed query, by the meaning of its parts."""
    if isinstance(node, Leaf):
        if node.field == "url":
            return node.tokens == (f"https://e.com/{k}",)
        texts = [words(t) for name, t in zip(("title", "body"), ROWS[k], strict=True) if node.field in (None, name)]
        n = len(node.tokens)
        return n > 0 and any(tuple(t[i : i + n]) == node.tokens for t in texts for i in range(len(t)))
    return not any(matches(x, k) for x in node.never) and all(matches(x, k) for x in node.must) and (bool(node.must) or any(matches(x, k) for x in node.may))


def test_query_syntax(spark):
    cases = {
        "fox": "1234", "and": "13", "not": "2", "or": "3", '"red fox"': "1", '"fox red"': "34", "red-fox": "1", "title:fox": "14", "title:fox body:cat": "134", "fox AND dog": "12", "fox AND NOT dog": "34", "+fox -dog": "34",
        "cat OR mouse": "3", "(cat OR dog) AND the": "13", "cat dog": "123", "+dog cat": "12", "-dog": "", "NOT dog": "", "url:https": "", 'url:"https://e.com/2"': "2", "... !": "", "zebra": "", "dog AND zebra": "",
    }
    fields = ("title", "body", "url")
    for q, want in cases.items():
        assert "".join(k for k in ROWS if matches(parse(q, fields), k)) == want, q
    for q in ("AND fox", "fox AND", "(fox", "fox)", '"fox', "colour:red", "title:", "()", "", "fox OR OR dog", "fox NOT"):
        with pytest.raises(BadQuery):
            parse(q, fields)
    index = search.Index(spark, docs(spark, *((k, *v) for k, v in ROWS.items())))
    for q in ('"red fox"', "fox AND NOT dog", '(cat OR dog) AND the title:"fox red"', "+fox -dog"):
        assert sorted(h["url"][-1] for h in index.search(q, 9).collect()) == [k for k in ROWS if matches(parse(q, fields), k)], q
    assert index.search("(fox", 9).count() == 0
    one, two = (index.search(q, 9).where("url like '%4'").first()["score"] for q in ("red", "red red"))
    assert abs(two - 2 * one) < 1e-9


def test_last_write_wins(spark):
    f = Frontier.empty(spark).discover(urls_of(spark, "https://e.com/a"))
    times = f.table.withColumn("last_crawled", F.explode(F.array(*(F.lit(x).cast("long") for x in (3, 9, 5, None)))))
    assert [r["last_crawled"] for r in f.put(times.repartition(4)).scan().collect()] == [9]
    rows = spark.createDataFrame([(1, 5, "b"), (1, 7, "c"), (1, 6, "d"), (2, 1, "x")], "k int, at int, v string")
    assert sorted(r["v"] for r in merge(rows.where("v = 'b'"), rows.where("v <> 'b'"), "k", ["at"]).collect()) == ["c", "x"]


def test_graph_numbers_a_large_fan_out(spark):
    many = spark.range(3000).select(F.lit("hub").alias("src"), F.format_string("n%05d", "id").alias("dst"))
    g = Graph.empty(spark).add_edges(many.limit(10).union(spark.createDataFrame([("a", "b")], "src string, dst string"))).add_edges(many)
    hub = g.edges.where("src = 'hub'").orderBy("pos").collect()
    assert [r["pos"] for r in hub] == list(range(3000)) and len({r["dst"] for r in hub}) == 3000
