"""Source mixing: targets against a plain loop, balance, reruns."""

import re

import numpy as np
import pytest

from ledgerlens.llm import catalog, mixing

SF01 = "/root/testdata/sf0.01"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in done]
        weight = sum(w[s] for s in left)
        if not weight:
            return done
        share = (total - sum(done.values())) / weight
        over = [s for s in left if w[s] * share >= 3 * sizes[s]]
        if not over:
            return done | {s: w[s] * share for s in left}
        done |= {s: 3.0 * sizes[s] for s in over}


def check(rows, texts):
    size = {}
    for t, s in texts:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(size)
    taken = {}
    for r, s in rows:
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    return want, taken


def test_query_targets_and_balance(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = catalog.QUERIES["op8_mix"](spark, SF01).collect()
    assert len(got) == len(docs)
    want, taken = check([(r, docs[r["doc_id"]]["source"]) for r in got], [(d["text"], d["source"]) for d in docs.values()])
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= 2 * largest for s in want)
    again = catalog.QUERIES["op8_mix"](spark, SF01).collect()
    assert sorted(got) == sorted(again)


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    pi, size = rng.random(500), rng.integers(1, 1000, 500)
    out = mixing.flight(pi, size, np.random.default_rng(1), False)
    assert ((out == 0) | (out == 1)).sum() >= 498
    assert out.sum() == pytest.approx(pi.sum()) and out @ size == pytest.approx(pi @ size)
    landed = mixing.flight(pi, size, np.random.default_rng(1), True)
    assert set(landed) <= {0.0, 1.0} and abs(landed.sum() - pi.sum()) <= 2 and abs(landed @ size - pi @ size) <= 2000


def test_inclusion_probabilities():
    pi, size = np.full(9, 1 / 3), np.arange(1, 10)
    n = sum(mixing.flight(pi, size, np.random.default_rng(s), True) for s in range(2000)) / 2000
    assert np.abs(n - pi).max() < 0.06


def test_rounds_and_edge_cases(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = [(i, "w " * (i % 7), None, "ab"[i % 2]) for i in range(150)] + [(500, None, None, None), (500, None, None, None), (501, "x y", None, None),
                                                                            (501, "x y", None, None), (None, "q", None, "é"), (502, "", None, "zero"), (503, "z " * 50_000, None, "big")]
    df = docs(rows)
    got = mixing.mix_report(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[502]["target"] == 0 and by[502]["taken"] == 0 and by[500]["size"] == 0
    source = {r[0]: r[3] for r in rows}
    check([(r, source[r["doc_id"]]) for r in got], [(r[1], r[3]) for r in rows])
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_report(df.limit(0)).count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0
