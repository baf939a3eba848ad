import random
import struct
import sys
import zlib
from collections import defaultdict
from hashlib import sha256
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import brute  # noqa: E402
from oracle import assert_same  # noqa: E402

import corpus_pipeline  # noqa: E402

from tessera.llm import queries  # noqa: E402
from tessera.llm.byte_bpe import Codec, bpe  # noqa: E402
from tessera.llm.common import attach_by_key, crc_mod, keyed  # noqa: E402
from tessera.llm.decontaminate import WuManber, decontaminate  # noqa: E402
from tessera.llm.exact_dedup import exact_dedup  # noqa: E402
from tessera.llm.language_id import CrossParser, identify, language_id, letters  # noqa: E402
from tessera.llm.near_dedup import BagMinHash, components, drop_near_duplicates, near_dedup, possible, shared_grams  # noqa: E402
from tessera.llm.quality import Fourier, isotonic, quality_scores, statistics  # noqa: E402
from tessera.llm.revisit import canonical_url, resolve_revisits  # noqa: E402
from tessera.llm.sharding import near_equal, pack, shard_by_bytes, smallest_capacity  # noqa: E402
from tessera.llm.substring_dedup import COVER, PERIOD, substring_dedup  # noqa: E402
from tessera.llm.token_counts import UnigramCounter, token_counts, vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, kept string, score double, id int"


def frame(spark, rows, tmp_path, parts=3):
    """Stored rows (id, text) with other columns whose names are used by results."""
    path = str(tmp_path / f"t{random.random()}")
    spark.createDataFrame([(i, t, "en", "clash", 0.5, 1) for i, t in rows], SCHEMA).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def awkward(seed=1):
    """Nulls, empty, long and repeated texts, near copies, shared passages, repeated rows and ids."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(r.choice([0, 1, 3, 12, 40, 90])) for _ in range(30)]
    passage = text(25)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t.replace(" ", "\n  ", 1)) for i, t in enumerate(base[:8])]  # equal but for white space
    for i in range(10):
        ws = base[i + 10].split()
        if ws:
            ws[r.randrange(len(ws))] = "changed"
        rows.append((200 + i, " ".join(ws)))
        rows.append((300 + i, f"{text(5)} {passage} {text(7)}"))
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, None), (None, base[3]), (None, "only null id here"), (5, base[5]), (5, base[5]), (5, base[6]), (404, "x " * 3000), (405, "y" * 20_000), (406, "... !!!"), (407, "日本語 テキスト 😀 " * 30)]
    return rows


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = frame(spark, awkward(), tmp_path_factory.mktemp("rows"))
    return df, [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return frame(spark, [], tmp_path_factory.mktemp("none"), 1)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert_same(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_exact_dedup(stored, nothing):
    df, rows = stored
    got = exact_dedup(df)
    assert got.columns == ["doc_id", "text", "lang", "score", "id", "keep_id", "group_size", "kept", "text_sha256"]
    want = brute.exact(rows)
    key = lambda x: tuple(map(str, x))
    assert sorted([(r["doc_id"], r["text"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()], key=key) == sorted([(*a, *b) for a, b in zip(rows, want, strict=True)], key=key)
    for options in ({}, {"max_filter_bits": 1, "bits_per_row": 1500}):  # one filter, and slices one after another
        light = exact_dedup(df, carry=["doc_id"], **options)
        assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in light.collect()], key=key) == sorted([(a[0], *b) for a, b in zip(rows, want, strict=True)], key=key)
    sliced = exact_dedup(df, max_filter_bits=1, bits_per_row=1500)
    assert sorted([(r["doc_id"], r["text"], r["keep_id"], r["kept"]) for r in sliced.collect()], key=key) == sorted([(*a, b[0], b[2]) for a, b in zip(rows, want, strict=True)], key=key)
    assert exact_dedup(nothing).count() == 0
    plan = exact_dedup(df, carry=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_attach_spreads_hot_groups(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 800, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = attach_by_key(rows, groups, "k", "n", F.col("id"))
    assert got.count() == 1000 and got.where("k = 0 and n = 800").count() == 800


def hashed(df):
    """Rows as the operators number them: (row, id, text)."""
    return [(r["row"], r["id"], r["text"]) for r in keyed(df, {"doc_id": "id", "text": "text"}).collect()]


def test_near_dedup(spark, stored, nothing):
    df, _ = stored
    places = sorted(hashed(df), key=lambda r: tuple(r[0]))  # of the same id, the least place stays
    rows = [(i, t) for _, i, t in places]
    want = brute.near_classes(rows)
    place = {tuple(row): k for k, (row, _, _) in enumerate(places)}
    got = near_dedup(df).collect()
    assert sorted(brute.ORDER(r["doc_id"]) for r in got) == sorted(brute.ORDER(i) for i, _ in rows)
    text_of = defaultdict(list)
    for i, t in rows:
        text_of[i].append(brute.bag(t))
    for r in got:
        k = place[tuple(r["row"])]
        best = want[k]
        assert r["class_id"] == rows[best][0] and r["class_size"] == want.count(best) and r["kept"] == (k == best)
        if r["class_size"] == 1:
            assert r["similarity"] is None
        elif r["similarity"] is not None:
            own = brute.bag(rows[k][1])
            assert r["similarity"] >= 0.8 and any(abs(sum((own & b).values()) / sum((own | b).values()) - r["similarity"]) < 1e-9 for b in text_of[r["link_id"]])
    # every class is connected: at most one row of it, whose bag has copies only, is without a link of its own
    linked = sum(r["class_size"] > 1 and r["similarity"] is None for r in got)
    assert linked <= len({best for best in want if want.count(best) > 1})
    kept = drop_near_duplicates(df)
    assert kept.count() == len(set(want)) and kept.columns == df.columns
    assert near_dedup(nothing).count() == 0 and drop_near_duplicates(nothing).count() == 0


def test_rows_keep_their_identity(spark, tmp_path):
    """A table whose rows come in another order in each job (as after a lost executor) gives the same result."""
    rnd = random.Random(13)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(40)) for _ in range(20)]
    rows = [*enumerate(texts), *list(enumerate(texts))[:12], *((100 + k, t + " end") for k, t in enumerate(texts[:6]))]
    rnd.shuffle(rows)
    (tmp_path / "reads").mkdir()

    def turned(batches):
        for batch in batches:
            nth = len(list((tmp_path / "reads").iterdir()))
            (tmp_path / "reads" / f"{nth}-{random.random()}").touch()
            first = nth * 7 % batch.num_rows
            yield batch.take([*range(first, batch.num_rows), *range(first)])

    df = frame(spark, rows, tmp_path, 1)
    moving = df.mapInArrow(turned, df.schema)
    for got, want in ((exact_dedup(moving).where("kept"), [at for at, x in enumerate(brute.exact(rows)) if x[2]]), (drop_near_duplicates(moving), set(brute.near_classes(rows)))):
        assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(rows[at] for at in want)
    assert sorted((r["doc_id"], r["kept"]) for r in substring_dedup(moving).collect()) == sorted((i, w) for (i, _), w in zip(rows, brute.substring(rows), strict=True))


def test_near_dedup_mixed_group(spark, tmp_path):
    """A chain of texts, each near the next but the ends far apart, and a large group of near copies."""
    r = random.Random(4)
    ws = [f"w{r.randrange(10**6)}" for _ in range(100)]
    rows = []
    for k in range(30):
        rows.append((k, " ".join(ws)))
        for _ in range(2):
            ws[r.randrange(100)] = f"w{r.randrange(10**6)}"
    big = [f"v{k}" for k in range(60)]
    rows += [(1000 + k, " ".join(big[:59] + [f"end{k}"])) for k in range(120)]
    df = frame(spark, rows, tmp_path, 4)
    order = [(x["doc_id"], x["text"]) for x in df.collect()]
    want = brute.near_classes(order)
    got = {x["doc_id"]: x["class_id"] for x in near_dedup(df).collect()}
    assert got == {i: order[w][0] for (i, _), w in zip(order, want, strict=True)}


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(5)
    sign = BagMinHash(4000)
    for top in (1, 3, 40):
        e = rng.integers(0, 2**63, 150).astype(np.uint64)
        a = rng.integers(0, top + 1, 150)
        b = np.where(rng.random(150) < 0.7, a, rng.integers(0, top + 1, 150))
        s = sign(np.concatenate([e[a > 0], e[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), 2)
        j = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - j) < 5 * np.sqrt(j * (1 - j) / 4000) + 1e-9
    assert np.isinf(sign(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), 1)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (102, 101), (200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys((100, 101, 102), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_grams(spark):
    """Cores and parts against sets; and the bound never rules out a pair that is near enough."""
    rnd = random.Random(15)
    base = [rnd.getrandbits(64) for _ in range(200)]
    sets = {k: {*rnd.sample(base, rnd.randint(150, 200)), *(rnd.getrandbits(64) for _ in range(rnd.randint(0, 40)))} for k in range(40)}
    store = spark.createDataFrame([(k, np.sort(np.array(list(s), np.uint64)).tobytes()) for k, s in sets.items()], "node long, grams binary").repartition(3)
    got = {r["node"]: r for r in shared_grams(store, 8000, per_task=1000).collect()}
    for k, s in sets.items():
        core = {g for g in s if any(g in t for j, t in sets.items() if j != k)}
        assert got[k]["core"] == len(core) and got[k]["parts"] == np.bincount([g >> 57 for g in core], minlength=128).tolist()
    nodes = spark.createDataFrame([(k, len(s), got[k]["core"], got[k]["parts"]) for k, s in sets.items()], "node long, n_shingles long, core long, parts array<short>")
    a, b = (nodes.select(F.struct("*").alias(name)) for name in "ab")
    able = {(r["x"], r["y"]) for r in a.crossJoin(b).where(possible(F.col("a"), F.col("b"), 0.8)).select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).collect()}
    near = {(x, y) for x in sets for y in sets if x != y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])}
    assert near <= able and len(able) < 1600


def test_near_dedup_many_variants(spark, tmp_path):
    """A large group of copies with few to many changes, of which some are near to none: all links are found."""
    rnd = random.Random(16)
    ws = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(250):
        copy = list(ws)
        for at in rnd.sample(range(150), rnd.choice((0, 1, 2, 3, 4, 5, 8, 12))):
            copy[at] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    df = frame(spark, rows, tmp_path, 3)
    order = [(x["doc_id"], x["text"]) for x in df.collect()]
    want = brute.near_classes(order)
    got = {x["doc_id"]: x["class_id"] for x in near_dedup(df).collect()}
    assert got == {i: order[w][0] for (i, _), w in zip(order, want, strict=True)}


def test_cover():
    assert all(any((i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER for d in range(PERIOD)) for i in range(PERIOD) for j in range(PERIOD))


def test_substring_dedup(spark, stored, nothing):
    df, rows = stored
    key = lambda x: tuple(map(str, x))
    for bits in (1 << 30, 1):  # with a filter of the least size more windows are compared, no result changes
        got = substring_dedup(df, max_filter_bits=bits)
        want = brute.substring(rows)
        assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()], key=key) == sorted([(i, len((t or "").encode().split()), len((t or "").encode().split()) - len(w.split()), w) for (i, t), w in zip(rows, want, strict=True)], key=key)
    assert substring_dedup(nothing).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(df, window=13)


def test_decontamination(spark, stored, nothing, tmp_path):
    df, rows = stored
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[5:20]).upper()), (2, "Changed!"), (3, None), (4, " .,;"), (5, texts[1]), (10, texts[1]), (6, "never there at all in any of these texts whatever happens"), (7, "日本語"), (None, texts[1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(rows, items)
    key = lambda x: tuple(map(str, x))
    for per_block in (500_000, 3):
        got = decontaminate(df, bench, per_block=per_block)
        flat = [(r["doc_id"], r["n_words"], tuple(sorted(k for s in r["spans"] for k in range(s["start"], s["end"]))), tuple(r["items"])) for r in got.collect()]
        by_text = lambda found: tuple(sorted(found, key=lambda x: (x is None, x or "")))
        assert sorted(flat, key=key) == sorted([(i, n, tuple(sorted(hit)), by_text(found)) for (i, _), (n, hit, found) in zip(rows, want, strict=True)], key=key)
    assert decontaminate(nothing, bench).count() == 0
    assert decontaminate(df, bench.limit(0)).where("size(spans) > 0").count() == 0
    words = [b"a", b"b"] * 6
    assert [s for s, _ in WuManber({(b"a", b"b", b"a"): {"x"}}).find(words)] == [0, 2, 4, 6, 8]
    assert [s for s, _ in WuManber({(b"b",): {"x"}}).find(words)] == [1, 3, 5, 7, 9, 11]


def test_byte_bpe(spark, stored, nothing):
    df, rows = stored
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    e = brute.encoding()
    got = bpe(df, path, public_tokenizers.PATTERN).select("text", "n_tokens", "token_ids", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = e.encode_ordinary(r["text"] or "")
        assert list(struct.unpack(f"<{len(ids)}I", r["token_ids"])) == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe(nothing, path, public_tokenizers.PATTERN).count() == 0
    c, rnd = Codec(path, public_tokenizers.PATTERN, cache_size=50), random.Random(2)
    odd = ["".join(rnd.choice("ab c\n\t'é1 9!   日") for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    odd += ["x" * 3000, "x" * 100_000, "".join(rnd.choice("abcdefghié") for _ in range(100_000)), "".join(rnd.choice("ab") for _ in range(5000)), "the" * 2000, "ab" * 700, " " * 200, "don't 's '", "a\n \n b", "１２３ ½", "́a‍"]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode_batch(odd)] == [e.encode_ordinary(t) for t in odd]


def test_token_counts(spark, stored, nothing):
    from tokenizers import Tokenizer, models, pre_tokenizers

    df, rows = stored
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = vocabulary(path)
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *pieces], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    key = lambda x: tuple(map(str, x))
    got = token_counts(df, path).collect()
    assert sorted([(r["doc_id"], r["n_tokens"]) for r in got], key=key) == sorted([(i, len(t.encode(x or "").ids)) for i, x in rows], key=key)
    assert token_counts(nothing, path).count() == 0
    tied = [("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("▁a", -3.0), ("aba", -6.0)]  # sums tie in many ways
    u = Tokenizer(models.Unigram([("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *tied], unk_id=0, byte_fallback=True))
    u.pre_tokenizer = t.pre_tokenizer
    rnd, mine = random.Random(3), UnigramCounter(tied)
    odd = ["".join(rnd.choice("aabb cé") for _ in range(rnd.randint(0, 20))) for _ in range(800)]
    assert [n for n, _ in mine.count(odd)] == [len(u.encode(x).ids) for x in odd]


def greedy(reference, s):
    """Phrases of the longest-match parse of s by the substrings of reference."""
    want = at = 0
    while at < len(s):
        size = 0
        while at + size < len(s) and s[at : at + size + 1] in reference:
            size += 1
        at += max(1, size)
        want += 1
    return want


def read(t):
    """What the parser reads of a text: its words of letters, each but a last one at the very end followed by a gap."""
    s = "".join(f"{w} " for w in letters(t).split())
    return s if letters(t).endswith(" ") else s[:-1]


def test_language_parsing():
    """Phrase counts are those of a direct greedy parse of the whole text, however it is cut into blocks."""
    rnd = random.Random(6)
    training = {"aa": "".join(rnd.choice("abc ") for _ in range(900)), "bb": "".join(rnd.choice("bcd ") for _ in range(700)), "cc": "ab" * 300}
    texts = ["".join(rnd.choice("abcdx ") for _ in range(rnd.randint(0, 170))) for _ in range(60)] + ["", "!!", "abcab", "q", "ab" * 400, "abab" * 90 + "c" + "ba" * 200, training["aa"], "x" * 130]
    for block, dense in ((1, 1 << 25), (7, 1 << 25), (50, 0), (1024, 1 << 25)):
        parser = CrossParser(training, block=block, dense_cells=dense)
        length, counts = parser.phrases(texts)
        known = [" ".join(letters(training[k]).split()) for k in parser.langs]
        for t, n, row in zip(texts, length, counts, strict=True):
            assert n == len(read(t)) and row.tolist() == [greedy(x, read(t)) for x in known]
    assert [x[0] for x in parser.classify(["", "!1", None, "abcab"])][:3] == ["und"] * 3


def spark_hash(*values):
    """Spark's xxhash64 of texts, unsigned."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode(), seed=h)
    return h


def test_language_id_against_plain(spark, sf):
    """The whole query on all texts that are not very long: the sample of labelled rows, and a greedy parse for each language."""
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    rows = [(i, t, g) for i, t, g in zip(docs.doc_id, docs.text, docs.lang, strict=True) if t and g is not None]
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    buckets = defaultdict(lambda: defaultdict(list))
    for i, t, g in rows:
        if zlib.crc32(str(i).encode()) % 5 and len(t) <= 20_000:
            h = signed(spark_hash(str(i), t))
            buckets[g][h % 320].append((h, t))
    training = {}
    for g, found in buckets.items():
        have = []
        for _, t in sorted(min(x) for x in found.values())[:80]:
            if sum(map(len, have)) < 40_000:
                have.append(t)
        training[g] = " ".join(letters("\n".join(have)).split())
    bits = {g: np.log2(len(t)) for g, t in training.items()}
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        s = read(t or "")
        if not s or len(s) > 1500:
            continue
        rate = {g: greedy(training[g], s) * bits[g] / len(s) for g in sorted(training)}
        best = min(rate, key=rate.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["bits_per_symbol"] - rate[best]) < 1e-9
        assert abs(got[i]["score"] - 1 / sum((rate[best] / x) ** 12 for x in rate.values())) < 1e-9


def many_letters(rnd, words, n):
    """Text of words of Chinese characters without spaces, the commonest about forty times as often as the rarest, in sentences."""
    picked = rnd.choices(words, [(k + 1) ** -0.5 for k in range(len(words))], k=n)
    return "".join(w + ("。" if rnd.random() < 0.1 else "") for w in picked)


def test_hashed_transitions():
    """The hashed transitions give what the whole table gives, for more letters than fit into a byte."""
    rnd = random.Random(11)
    cjk = [chr(0x4E00 + k) for k in range(3000)]
    training = {"aa": "".join(rnd.choice("abc ") for _ in range(900)), "cc": "".join(cjk) + "".join(rnd.choice(cjk[:500]) for _ in range(3000)), "dd": ""}
    whole, hashed = CrossParser(training, 64, 1 << 40), CrossParser(training, 64, 0)
    assert whole.next is None and hashed.table is None and whole.n_symbols == 3005
    texts = ["".join(rnd.choice(["a", "b", "c", " ", "q", "!", "я", *cjk[:500]][:8 if k % 2 else None]) for _ in range(rnd.randint(0, 300))) for k in range(100)]
    texts += ["", "!", "".join(cjk), *training.values()]
    for a, b in zip(whole.phrases(texts), hashed.phrases(texts), strict=True):
        assert (a == b).all()
    assert whole.classify(texts) == hashed.classify(texts)


def test_language_of_3000_letters(spark, tmp_path):
    """Held-out texts of a learned language with 3,000 letters stay in the corpus, beside one with an alphabet."""
    rnd = random.Random(12)
    cjk = [chr(0x4E00 + k) for k in range(3000)]
    rnd.shuffle(cjk)
    words = ["".join(cjk[at : at + 2]) for at in range(0, 3000, 2)]
    rnd.shuffle(words)
    latin = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(800)]
    rows = [(k, many_letters(rnd, words, 150), "zh", "s", 1) for k in range(200)]
    rows += [(1000 + k, " ".join(rnd.choice(latin) for _ in range(60)), "en", "s", 1) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in corpus_pipeline.keep_identified(spark, docs, "").collect()]
    assert sorted(kept) == sorted(r[0] for r in rows)
    found = language_id(docs, learn=crc_mod(F.col("doc_id"), 5) != 0)
    assert found.where("lang_pred <> lang").count() == 0


def test_language_of_long_texts(spark):
    """A language whose texts are all over the bound is learned from the start of its shortest one."""
    rnd = random.Random(14)
    text = lambda chars, n: " ".join("".join(rnd.choice(chars) for _ in range(4)) for _ in range(n))
    rows = [(k, text("abcde", 20), "aa") for k in range(20)] + [(100 + k, text("vwxyz", 100 + k), "zz") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id(docs, learn=F.lit(True), max_row_chars=200).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found)
    only = language_id(docs.where("lang = 'zz'"), learn=F.lit(True), max_row_chars=200, chars_per_lang=300).collect()
    assert {r["lang_pred"] for r in only} == {"zz"}


def test_language_id(spark, sf, stored, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op2_language_id(spark, sf).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").toPandas()
    held = got[got.held_out & (got.n >= 20)]
    assert len(got) == docs.count() and (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    df, rows = stored
    found = language_id(df, learn=crc_mod(F.col("doc_id"), 5) != 0)
    assert found.count() == len(rows) and found.columns[-4:] == ["lang_pred", "score", "bits_per_symbol", "n_symbols"]
    assert {r["lang_pred"] for r in found.where("text is null or text in ('', '... !!!')").collect()} == {"und"}
    assert language_id(nothing, learn=F.lit(True)).count() == 0
    assert identify(df, {}).where("lang_pred <> 'und'").count() == 0


def test_quality(spark, sf, stored, nothing):
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op5_quality(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert ((held.predicted == held.quality).mean()) > 0.95 and got.score.between(0, 1).all() and len(got) == 1000
    df, rows = stored
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_scores(df, none, F.lit(True)).where("score <> 0.5").count() == 0
    some = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, None), (None, 1)], "doc_id long, quality int")
    assert quality_scores(df, some, F.lit(True)).where("score between 0 and 1").count() == len(rows)
    assert quality_scores(nothing, some, F.lit(True)).count() == 0
    assert not any(statistics(None)) and len(statistics("a b")) == len(statistics(""))


def test_quality_against_plain(spark):
    """The whole query with plain numpy: split, statistics, ridge over the features, and the isotonic fit by its definition."""
    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    label = {i: y for i, y in zip(*pd.read_parquet(f"{sf}/labels.parquet")[["doc_id", "quality"]].to_numpy().T, strict=True) if zlib.crc32(str(i).encode()) % 3 != 1}
    x = np.array([statistics(t) for t in docs.text])
    known = np.array([i in label for i in docs.doc_id])
    y = np.array([label.get(i, 0) for i in docs.doc_id], float)
    part = np.array([spark_hash(str(i)) % 4 for i in docs.doc_id])
    f = Fourier(x[known].mean(0), x[known].std(0), 300, 4.0)
    z = f(x)
    fit, held = known & (part != 0), known & (part == 0)
    a = z[fit].T @ z[fit]
    raw = z @ np.linalg.solve(a + 1e-3 * max(1.0, np.trace(a) / len(a)) * np.eye(len(a)), z[fit].T @ y[fit])
    order = np.argsort(raw[held], kind="stable")
    s, t = raw[held][order], y[held][order]
    sums = np.concatenate([[0], np.cumsum(t)])
    value = [max(min((sums[b] - sums[a]) / (b - a) for b in range(i + 1, len(t) + 1)) for a in range(i + 1)) for i in range(len(t))]
    want = np.clip(np.interp(raw, s, value) + 1e-6 * np.tanh(raw - 0.5), 0, 1)
    got = {r["doc_id"]: r["score"] for r in queries.op5_quality(spark, sf).collect()}
    assert max(abs(got[i] - w) for i, w in zip(docs.doc_id, want, strict=True)) < 1e-6


def test_isotonic_and_kernel():
    at, value = isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert np.interp([1, 2, 3, 5], at, value).tolist() == [0, 0.5, 0.5, 1]
    f = Fourier(np.zeros(4), np.ones(4), 20_000, 2.0)
    x = np.random.default_rng(1).normal(size=(6, 4))
    z = f(x)[:, :-1]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-d / 8)).max() < 0.05


def test_sharding(spark, stored, nothing):
    df, rows = stored
    got = shard_by_bytes(df, 4).toPandas()
    assert len(got) == len(rows) and (got.groupby("group_key").shard.nunique() == 1).all()
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    assert got.groupby("shard")["size"].sum().max() <= max(got.group_size.max(), -(-got["size"].sum() // 4) + got["size"].min() + 100)
    assert shard_by_bytes(nothing, 4).count() == 0


def test_best_fit_decreasing():
    """The batched packing against one item at a time."""
    rnd = random.Random(8)
    for _ in range(200):
        items = sorted((rnd.randint(1, 30) for _ in range(rnd.randint(1, 60))), reverse=True)
        capacity = rnd.randint(30, 80)
        rest = []
        for x in items:
            fits = [(r, k) for k, r in enumerate(rest) if r >= x]
            if fits:
                rest[min(fits)[1]] -= x
            else:
                rest.append(capacity - x)
        classes = [(s, items.count(s)) for s in sorted(set(items), reverse=True)]
        plan, used = pack(classes, capacity)
        assert sorted(used) == sorted(capacity - r for r in rest)
        assert [sum(n for _, n in p) for p in plan] == [n for _, n in classes]
        plan, used = smallest_capacity(classes, 4)
        assert len(used) <= 4 and sum(used) == sum(items)


def test_sharding_hot_group(spark, tmp_path):
    """A group with a third of all bytes is alone, and the other shards are near equal."""
    rnd = random.Random(9)
    rows = [(k, "hot " * 250) for k in range(100)] + [(1000 + k, f"{k} " + "x" * rnd.randint(50, 550)) for k in range(650)]
    got = shard_by_bytes(frame(spark, rows, tmp_path), 16).toPandas()
    loads = got.groupby("shard")["size"].sum()
    hot = got[got.doc_id < 100].shard.unique()
    assert len(loads) == 16 and len(hot) == 1 and loads[hot[0]] == 100 * 1001
    rest = loads.drop(hot[0])
    assert rest.max() <= 1.01 * rest.mean() and rest.min() >= 0.98 * rest.mean()


def test_sharding_against_plain(spark):
    """The whole query: best fit over all groups, one at a time."""
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    groups = defaultdict(int)
    for t in docs.text:
        groups[t or ""] += len((t or "").encode()) + 1
    got = queries.op6_sharding(spark, "/root/testdata/sf0.01").toPandas()
    assert sorted(got.groupby("shard")["size"].sum()) == sorted(brute.near_equal(list(groups.values()), 16))
    assert (got.groupby("group_key").shard.nunique() == 1).all() and got.group_key.nunique() == len(groups)


def test_near_equal():
    """Every item is placed once, no shard stays empty while there are items enough, and the fullest is no fuller than by one capacity."""
    assert sorted(near_equal([(10, 17)], 16)[1]) == [10] * 15 + [20]
    rnd = random.Random(10)
    for _ in range(300):
        items = [rnd.choice((1, rnd.randint(1, 30), rnd.randint(1, 400))) for _ in range(rnd.randint(0, 60))]
        shards = rnd.randint(1, 16)
        classes = [(s, items.count(s)) for s in sorted(set(items), reverse=True)]
        plan, used = near_equal(classes, shards)
        loads = [0] * len(used)
        for (size, n), bins in zip(classes, plan, strict=True):
            assert sum(k for _, k in bins) == n
            for b, k in bins:
                loads[b] += size * k
        assert loads == used and len(used) == min(shards, len(items))


RECORDS = "record_id long, url string, kind string, ts long, headers map<string,string>, digest string, status string"


def test_revisits(spark):
    r = lambda i, ts, kind, h=None, d=None, url="http://E.com:80/a#x": (i, url, kind, ts, h, d, "clash")
    rows = [
        r(1, 10, "response", {"etag": '"1"', "content-type": "t", "date": "d1"}, "D1"), r(2, 20, "revisit", {"etag": 'W/"1"', "date": "d2", "content-length": "0"}, url="http://e.com/a"),
        r(3, 30, "response", {"etag": '"2"', "last-modified": "m"}, "D2"), r(4, 40, "revisit", {"etag": '"1"'}), r(5, 50, "revisit", {"last-modified": "m"}), r(6, 60, "revisit", {"date": "x"}), r(7, 5, "revisit", {"etag": '"1"'}),
        r(8, 70, "revisit", None, "D2"), r(9, 70, "revisit", None, "D9"), r(10, 80, "revisit", {"etag": '"2"'}, url=None), r(11, 80, "revisit", {}, url="not a url"), r(12, 30, "revisit", {"etag": '"2"'}), r(13, 90, "metadata"), r(14, None, "revisit", {"etag": '"1"'}),
        r(15, 10_000, "revisit", {"etag": '"2"', "vary": "v"}), r(16, 9_000, "revisit", {"etag": '"q"'}, url="https://e.com/a"),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    for number in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", number)
        got = {x["record_id"]: (x["base_id"], x["status"]) for x in resolve_revisits(df).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert got == {2: (1, "resolved"), 4: (3, "validator_mismatch"), 5: (3, "resolved"), 6: (3, "no_validator"), 7: (None, "no_response"), 8: (3, "resolved"), 9: (3, "validator_mismatch"), 10: (None, "bad_url"), 11: (None, "bad_url"), 12: (3, "resolved"), 14: (None, "no_response"), 15: (3, "resolved"), 16: (None, "no_response")}
    found = {x["record_id"]: x for x in resolve_revisits(df).collect()}
    assert found[2]["headers"] == {"etag": 'W/"1"', "content-type": "t", "date": "d2"} and found[2]["digest"] == "D1" and found[4]["headers"] is None
    assert resolve_revisits(df.limit(0)).count() == 0
    # one moment, repeated rows, null ids
    burst = [r(k, 5, "response" if k % 10 == 0 else "revisit", {"etag": f'"{k // 10}"'}) for k in range(300)] * 2 + [r(None, 5, "response", {"etag": '"n"'}), r(None, 5, "revisit", {"etag": '"n"'}), r(None, 6, "revisit", {"etag": '"29"'})]
    found = resolve_revisits(spark.createDataFrame(burst, RECORDS).repartition(5)).collect()
    assert len(found) == 2 * 270 + 2 and all(x["status"] == "resolved" and x["base_id"] == x["record_id"] // 10 * 10 for x in found if x["record_id"] is not None)
    assert sorted((x["ts"], x["status"], x["base_id"]) for x in found if x["record_id"] is None) == [(5, "no_response", None), (6, "resolved", 290)]
    urls = spark.createDataFrame([("HTTPS://A.b:443?q#f",), ("http://a.b:443/x",), ("ftp://a:21/",), ("/x",), (None,)], "u string")
    assert [x[0] for x in urls.select(canonical_url(F.col("u"))).collect()] == ["https://a.b/?q", "http://a.b:443/x", "ftp://a/", None, None]


def test_query_contracts(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    e = brute.encoding()
    for r in queries.op8_byte_bpe(spark, sf).collect():
        ids = e.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r["decoded_sha256"] == brute.sha(docs[r["doc_id"]])
    shards = queries.op6_sharding(spark, sf).toPandas()
    assert len(shards) == len(docs) and shards.shard.between(0, 15).all() and shards.grown_shard.isna().all() and set(shards.law) == {"bytes"}
    by = defaultdict(set)
    for i, c in brute_classes(docs).items():
        by[c].add(i)
    got = queries.op9_near_dedup(spark, sf).toPandas()
    assert {frozenset(g) for _, g in got.groupby("class_id").doc_id} == {frozenset(g) for g in by.values()}


def brute_classes(docs):
    rows = list(docs.items())
    return {rows[k][0]: rows[c][0] for k, c in enumerate(brute.near_classes(rows))}
