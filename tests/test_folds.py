"""Folds of a hot key: blocks side by side equal the plain fold; wrong starts are repaired, and only they."""

import random
from collections import defaultdict

import pytest

from ledgerlens.operators import folds


def plain_cap(rows):
    out, hist = {}, defaultdict(list)
    for key, t, i, c in sorted(rows):
        h = hist[key]
        med = folds._median(h)
        if c is None:
            out[i] = (None, None)
            continue
        if c > 1.0:
            out[i] = (True, med)
            continue
        over = med is not None and med != 0 and c > 3 * med
        if not over and c >= 0:
            h.append(c)
            del h[:-50]
        out[i] = (over, med)
    return out


def plain_admission(rows, limit, window):
    out, times = {}, defaultdict(list)
    for key, t, i, _ in sorted(rows):
        q = times[key] = [x for x in times[key] if x > t - window]
        out[i] = len(q) < limit
        if out[i]:
            q.append(t)
    return out


@pytest.fixture
def rounds(monkeypatch):
    """The blocks of each round of end states."""
    seen, ends = [], folds._block_ends

    def watch(ranged, key, fold, starts, last):
        seen.append(sorted(starts))
        return ends(ranged, key, fold, starts, last)
    monkeypatch.setattr(folds, "_block_ends", watch)
    return seen


def hot_rows(n, seed, cost):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.9 else f"k{rng.randrange(20)}", 10 * i, i, cost(rng, i)) for i in range(n)]


def run_cap(spark, rows, parts=8):
    df = spark.createDataFrame(rows, "k string, t long, i long, cost double").repartition(3)
    out = folds.median_cost_cap(df, ["k"], "cost", ["t", "i"], parts)
    return {r["i"]: (r["exceeded"], r["median"]) for r in out.collect()}


def test_hot_key_spreads_and_equals_the_plain_fold(spark, rounds):
    rows = hot_rows(3000, 1, lambda rng, i: None if i % 17 == 0 else rng.choice([0.01, 0.02, 0.03, 0.2, 1.5]))
    assert run_cap(spark, rows) == plain_cap(rows)
    assert len(rounds[0]) >= 5                  # the hot key lies in many blocks


def test_wrong_starts_are_repaired_round_by_round(spark, rounds):
    # prices rise tenfold: all later calls are refused, so no block but the first changes the history, and every guess is wrong
    rows = [("hot", i, i, 0.01 if i < 200 else 0.1 + (i % 7) / 100) for i in range(1600)] + [(f"z{i}", 0, 10_000 + i, 0.5) for i in range(50)]
    assert run_cap(spark, rows) == plain_cap(rows)
    assert len(rounds) >= 3                     # the first round and two repairs at least
    assert all(len(b) <= len(a) for a, b in zip(rounds, rounds[1:]))


@pytest.mark.parametrize("gap", [False, True])
def test_admission_of_a_hot_key(spark, rounds, gap):
    rows = [(k, t + (500 if gap else 0) * (i // 100), i, c) for k, t, i, c in hot_rows(1500, 2, lambda rng, i: None)]
    df = spark.createDataFrame(rows, "k string, t long, i long, cost double").repartition(3)
    out = folds.segmented_admission(df, "k", "t", ["i"], 3, 400, 8)
    assert {r["i"]: r["ok"] for r in out.collect()} == plain_admission(rows, 3, 400)
    if gap:
        assert sum(map(len, rounds)) <= 2 * len(rounds[0])


def test_empty_and_null_keys(spark):
    rows = [(None, 1, 1, 0.1), (None, 2, 2, 0.9), ("a", 1, 3, None)]
    df = spark.createDataFrame(rows, "k string, t long, i long, cost double")
    got = {r["i"]: r["exceeded"] for r in folds.median_cost_cap(df, ["k"], "cost", ["t", "i"], 3).collect()}
    assert got == {1: False, 2: True, 3: None}
    assert folds.median_cost_cap(df.limit(0), ["k"], "cost", ["t", "i"]).count() == 0
