import itertools


from tessera.operators.quorum import reconcile_retail, reconcile_web
from tessera.schemas import QuorumParams

OBS = "observer string, seq long, store string, sku string, availability string, quantity long, observed_at long"


def answers(spark, cases, now=5000):
    """Each case is (votes, k, tolerance); a vote is (observer, availability, quantity, at). All cases of equal params run together."""
    out = {}
    for params in {(k, t) for _, k, t in cases.values()}:
        rows = [(o, i, "s", name, a, q, at) for name, (votes, *p) in cases.items() if tuple(p) == params for i, (o, a, q, at) in enumerate(votes)]
        df = reconcile_retail(spark.createDataFrame(rows, OBS), now, QuorumParams(params[0], 3600, params[1]))
        out |= {r["sku"]: (r["availability"], r["quantity"], r["support"], r["dissent"]) for r in df.collect()}
    return {name: out.get(name) for name in cases}


def votes(*pairs, at=5000):
    return [(f"o{i}", a, q, at) for i, (a, q) in enumerate(pairs)]


IN, OUT, UNKNOWN = "in_stock", "out_of_stock", "unknown"


def test_cases(spark):
    cases = {
        "below k": (votes((IN, 1)), 3, 2),
        "stuffing": ([("o", IN, 1, 5000 + i) for i in range(9)], 3, 2),
        "agree": (votes((IN, 10), (IN, 11), (IN, 9)), 3, 2),
        "stale": ([("a", IN, 1, 0), ("b", IN, 1, 0), ("c", IN, 1, 5000)], 3, 2),
        "dissent": (votes((IN, None), (IN, None), (IN, None), (OUT, None)), 3, 2),
        "tie": (votes((IN, 1), (IN, 1), (OUT, 0), (OUT, 0)), 2, 2),
        "three-way tie": (votes((IN, 1), (OUT, 0), (UNKNOWN, None)), 1, 2),
        "unknown": (votes((UNKNOWN, None), (UNKNOWN, None), (UNKNOWN, None)), 3, 2),
        "upper median": (votes((IN, 10), (IN, 11), (IN, 12), (IN, 13)), 4, 2),
        "outlier": (votes((IN, 10), (IN, 10), (IN, 11), (IN, 9_000_000)), 3, 2),
        "scattered": (votes((IN, 3), (IN, 40), (IN, 900)), 3, 2),
        "scattered wide": (votes((IN, 3), (IN, 40), (IN, 900)), 3, 1000),
        "exactly k near": (votes((IN, 9), (IN, 10), (IN, 11), (IN, 99)), 3, 2),
        "fewer than k near": (votes((IN, 9), (IN, 10), (IN, 11), (IN, 99)), 4, 2),
        "exact tolerance": (votes((IN, 9), (IN, 10), (IN, 11), (IN, 99)), 3, 1),
        "dissenters apart": (votes((IN, 10), (IN, 10), (IN, 10), (OUT, 0), (OUT, 0)), 3, 2),
        "few counts": (votes((IN, 10), (IN, 10), (IN, None), (IN, None)), 3, 2),
        "zero": (votes((OUT, 0), (OUT, 0), (OUT, 0)), 3, 0),
        "null": (votes((OUT, None), (OUT, None), (OUT, None)), 3, 0),
        "supersede": ([("a", IN, 1, 4100), ("a", OUT, 0, 4200), ("b", OUT, 0, 4200), ("c", OUT, 0, 4200)], 3, 2),
        "first of equal times": ([("a", OUT, 0, 4200), ("a", IN, 5, 4200), ("b", OUT, 0, 4200), ("c", OUT, 0, 4200)], 3, 2),
        "window edge": (votes((IN, 1), (IN, 1), (IN, 1), at=1400), 3, 2),
        "past the edge": (votes((IN, 1), (IN, 1), (IN, 1), at=1399), 3, 2),
        "future": (votes((IN, 1), (IN, 1), (IN, 1), at=9999), 3, 2),
    }
    got = answers(spark, cases)
    assert got == {
        "below k": None, "stuffing": None, "agree": (IN, 10, 3, 0), "stale": None, "dissent": (IN, None, 3, 1), "tie": None, "three-way tie": None, "unknown": (UNKNOWN, None, 3, 0),
        "upper median": (IN, 12, 4, 0), "outlier": (IN, 11, 4, 0), "scattered": (IN, None, 3, 0), "scattered wide": (IN, 40, 3, 0), "exactly k near": (IN, 11, 4, 0), "fewer than k near": (IN, None, 4, 0),
        "exact tolerance": (IN, None, 4, 0), "dissenters apart": (IN, 10, 3, 2), "few counts": (IN, None, 4, 0), "zero": (OUT, 0, 3, 0), "null": (OUT, None, 3, 0), "supersede": (OUT, 0, 3, 0),
        "first of equal times": (OUT, 0, 3, 0), "window edge": (IN, 1, 3, 0), "past the edge": None, "future": (IN, 1, 3, 0),
    }


def test_order_does_not_matter(spark):
    base = votes((IN, 10), (IN, 12), (OUT, 0), (IN, 11))
    cases = {f"p{i}": (list(p), 3, 2) for i, p in enumerate(itertools.permutations(base))}
    assert len(set(answers(spark, cases).values())) == 1


WEB = "observer string, seq long, url string, source_hash binary, observed_at long"


def web(spark, rows, k, per_url=True):
    df = spark.createDataFrame([(f"o{i}", i, u, bytes([h]) * 32, 100) for i, (u, h) in enumerate(rows)], WEB)
    return sorted((r["url"], r["source_hash"][0], r["support"], r["dissent"]) for r in reconcile_web(df, 100, QuorumParams(k), per_url).collect())


def test_web(spark):
    assert web(spark, [("a", 1), ("a", 1), ("a", 1), ("a", 2)], 3) == [("a", 1, 3, 1)]
    assert web(spark, [("a", 1), ("a", 1), ("a", 2)], 3) == []  # a plurality below k
    assert web(spark, [("a", 1), ("a", 1), ("a", 0), ("a", 0), ("a", 0)], 2) == [("a", 1, 2, 0)]  # void hashes count for nothing
    assert web(spark, [("a", 0)] * 5, 1) == []
    assert web(spark, [("a", 1), ("a", 1), ("a", 2), ("a", 2)], 2) == []
    assert web(spark, [("a", 1), ("a", 1), ("b", 1), ("b", 1)], 2) == [("a", 1, 2, 0), ("b", 1, 2, 0)]
    assert web(spark, [("a", 1), ("a", 1), ("b", 1), ("b", 1)], 2, per_url=False) == []  # other urls split the vote


def test_one_exchange_by_observer_and_one_by_subject(spark):
    df = spark.createDataFrame([], OBS)
    plan = reconcile_retail(df, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Python") == 0
    assert plan.count("Exchange hashpartitioning") <= 4
