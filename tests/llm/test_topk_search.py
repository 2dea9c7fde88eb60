"""Top-k search against brute force: blocks, groups of queries, ties, copies and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import catalog, topk_search

from .conftest import SF


def brute(rows, k=5):
    whole = []
    for i, v in rows:
        ok = v is not None and all(x is not None and np.isfinite(x) for x in v)
        whole.append([int(np.floor(256 * float(x))) for x in v] if ok and all(abs(256 * float(x)) < 2 ** 26 - 1 for x in v) else None)
    out = []
    for i, (q, _) in enumerate(rows):
        if whole[i] is None or q is None or q % 50:
            continue
        hits = [(-sum(a * b for a, b in zip(whole[i], w)), d is None, d or 0) for j, (d, w) in enumerate(zip((r[0] for r in rows), whole))
                if j != i and w is not None and len(w) == len(whole[i])]
        out += [(q, n, None if none else d, -s) for n, (s, none, d) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, row int").repartition(parts)
    return sorted((tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()), key=str)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=dim) / np.sqrt(dim)]) for i in range(n)]


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((tuple(r) for r in catalog.QUERIES["op11_topk_search"](spark, SF).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("block, group", [(4096, 16384), (90, 3)])
def test_blocks_groups_ties_and_copies(spark, monkeypatch, block, group):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "GROUP", group)
    rows = vectors(900, 8, 1)
    rows += [(1000 + i % 70, rows[50][1]) for i in range(200)]              # copies of a query, ids repeated
    rows += [(2000 + i, [0.5 * (i % 3 - 1)] * 8) for i in range(100)]       # ties
    assert run(spark, rows) == brute(rows)


def test_stopping_early_is_exact(monkeypatch):
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(3000, 24)) / 5).astype(np.int64)
    v[100:400] = v[7] + rng.integers(-2, 3, (300, 24))
    lists = topk_search.SortedLists(np.ma.array(np.arange(3000)), np.arange(3000), v)
    full = v @ v.T
    narrowed = []
    partition = np.partition
    monkeypatch.setattr(topk_search.np, "partition", lambda *a, **kw: (narrowed.append(a[0].shape), partition(*a, **kw))[1])
    for i, at, score in lists.best(v[:200], np.arange(200), 5):
        want = sorted((-int(full[i, j]), j) for j in range(3000) if j != i)[:5]
        assert [(-s, j) for s, j in zip(score.tolist(), at.tolist())] == want
    assert min(s[0] for s in narrowed if len(s) == 2) < 200                 # some queries stopped before the others


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, -1.0]), (50, [0.0, -1.0]), (100, None), (150, [nan, 1.0]), (200, [None, 1.0]), (250, [inf, 1.0]),
            (300, []), (301, []), (350, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (400, [1e9, 0.0]), (-50, [0.3, -0.7])]
    assert run(spark, rows) == brute(rows)
    big = [(0, [2.0 ** 17] * 64), (1, [2.0 ** 17] * 64), (2, [2.0 ** 17] * 63 + [2.0 ** 17 - 2.0 ** -6])]
    assert run(spark, big) == brute(big)
    for none in ([], [(1, [1.0])]):
        assert run(spark, none) == []
