import sys
from pathlib import Path

import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402


def test_against_plain_stages(spark, sf):
    """All stages as plain Python; of language identification only what it must reject."""
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    items = [tuple(x) for x in pd.read_parquet(f"{sf}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False)]
    rows = [(i, t) for i, t in zip(docs.doc_id, docs.text, strict=True) if any(c.isalpha() for c in t)]
    rows = [r for r, (_, _, kept) in zip(rows, brute.exact(rows), strict=True) if kept]
    rows = [r for k, (r, c) in enumerate(zip(rows, brute.near_classes(rows), strict=True)) if c == k]
    rows = [r for r, (_, hit, _) in zip(rows, brute.contamination(rows, items), strict=True) if not hit]
    e = brute.encoding()
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(e.encode_ordinary(t)) for i, t in rows}
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)


def test_awkward_rows(spark, tmp_path):
    rows = [(1, None, "en"), (2, "", "en"), (3, "...", None), (4, "plain words here and there", "en"), (5, "plain  words here\nand there", "en"), (None, "other text entirely", None), (6, "слова на другом языке", "en"), (4, "plain words here and there", "en")]
    spark.createDataFrame([(i, t, g, "s", 1) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {1, 2, 3, 5} & kept == set() and {4, None} <= kept


def test_empty_table(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_stay_as_they_are(spark, tmp_path):
    """Input columns with the names of results, and others, come through the filters unchanged; encoding renames those it has itself."""
    clash = ["score", "lang_pred", "bits_per_symbol", "kept", "keep_id", "group_size", "text_sha256", "items", "spans", "n_words", "row", "id", "class_id", "n_tokens", "round_trip", "odd name"]
    words = ["plain", "words", "here", "and", "there", "again", "more", "of", "them"]
    rows = [(i, " ".join(words[(i * k) % 9] for k in range(20)) + f" n{i}", "en", "s", 1, *(f"{c} {i}" for c in clash)) for i in range(40)]
    spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *clash]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = {r["doc_id"]: r.asDict() for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r.asDict() == before[r["doc_id"]] for r in rows), name
    coded = corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()
    for r in coded:
        have, old = r.asDict(), before[r["doc_id"]]
        assert have["round_trip"] and have["n_tokens"] > 0 and all(have[f"{c}_in" if c in ("n_tokens", "round_trip") else c] == old[c] for c in old)
