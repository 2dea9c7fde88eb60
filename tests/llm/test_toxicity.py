"""Toxicity: held-out accuracy, features against brute force, edge cases."""

import numpy as np

from ledgerlens.llm import catalog, toxicity

SF01 = "/root/testdata/sf0.1"


def test_features_are_the_distinct_ngrams(monkeypatch):
    seen = np.zeros(toxicity.BUCKETS, np.int32)
    text = "Some TEXT some text " * 40 + "é"
    codes = toxicity._codes(text)
    want = set()
    for n in toxicity.ORDERS:
        for i in range(len(codes) - n + 1):
            h = int(codes[i])
            for c in codes[i + 1:i + n]:
                h = (h * int(toxicity._BASE) + int(c)) % (1 << 64)
            want.add((h + n) * int(toxicity._MIX) % (1 << 64) >> 64 - toxicity.BUCKET_BITS)
    for window in (toxicity.WINDOW, 37):
        monkeypatch.setattr(toxicity, "WINDOW", window)
        got = toxicity.present(text, seen).tolist()
        assert len(got) == len(set(got)) and set(got) == want and not seen.any()


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    out = catalog.QUERIES["op4_toxicity"](spark, SF01)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == 1 for r in rows if r["toxic"] == 1) / sum(r["toxic"] == 1 for r in rows)
    wrong = sum(r["predicted"] == 1 for r in rows if r["toxic"] == 0) / sum(r["toxic"] == 0 for r in rows)
    assert hit >= 0.85 and wrong <= 0.02


def test_edge_cases(spark, docs):
    bad = docs([(i, f"you worthless idiot number {i}" if i % 2 else f"a calm and friendly note {i}") for i in range(200)]
               + [(900, None), (901, ""), (901, ""), (None, "idiot"), (902, "calm " * 100_000 + "worthless idiot")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (901, None), (5, 1)], "doc_id long, toxic int")
    model = toxicity.train(bad, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(bad.select("doc_id", "text").fillna(""), model).collect()}
    assert got[900] == got[901] and 0 <= got[900] <= 1
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(200))
    kept = toxicity.keep_clean(bad, labels)
    assert kept.columns == bad.columns and {r["doc_id"] for r in kept.collect()} >= set(range(0, 200, 2))
    none = toxicity.train(bad, labels.limit(0))
    assert toxicity.score(bad.limit(0).select("text"), none).count() == 0
    assert {r["score"] for r in toxicity.score(bad.select("text").fillna(""), none).collect()} == {1 / (1 + np.exp(30))}


def test_rare_label_is_learned_at_every_size(spark, docs):
    """Six toxic rows among 1,500: all are fitted on, and the n-gram counts come from every labelled row."""
    toxic = range(0, 1500, 150)
    df = docs([(i, f"you worthless idiot number {i}" if i in toxic else f"a calm and friendly note {i}") for i in range(1500)])
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(1500)], "doc_id long, toxic int")
    for max_rows in (60, 10_000):
        model = toxicity.train(df, labels, max_rows=max_rows)
        got = {r["doc_id"]: r["score"] for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
        assert all((got[i] >= 0.5) == (i in toxic) for i in range(1500))


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", 5.0)], "doc_id long, text string, Score double")
    out = toxicity.score(df, {"w": np.zeros(toxicity.BUCKETS, np.float32), "b": 0.0})
    assert out.columns == ["doc_id", "text", "score"] and out.first()["score"] == 0.5
