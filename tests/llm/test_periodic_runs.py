"""Runs of periodic words against a plain search of all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import catalog, periodic_runs

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    n, found = len(words), {}
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    for q in range(1, n // 3 + 1):
        breaks = np.flatnonzero(np.concatenate([[True], w[:-q] != w[q:], [True]]))      # breaks[i] - 1: a place that differs
        for a, b in zip(breaks, breaks[1:]):
            s, length = int(a), int(b - a - 1) + q
            if b - a > 1 and length >= max(24, 3 * q) and (s, length) not in found:
                found[s, length] = q
    return sorted((s, length, q) for (s, length), q in found.items())


def digest(doc_id, words):
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [True] * len(words)
    for s, length, q in runs:
        kept[s + q:s + length] = [False] * (length - q)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for w, k in zip(words, kept) if k).encode()).hexdigest())


def plant(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def key(r):
    return tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in r)


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((digest(d, plant(d, t)) for d, t in rows), key=key)
    got = sorted((tuple(r) for r in catalog.QUERIES["op12_periodic_runs"](spark, SF).collect()), key=key)
    assert got == want
    assert any(r[1] for r in got)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def structured(rng):
    """Texts with nested, neighbouring and broken periods."""
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(0, 200))]
    out = []
    while len(out) < rng.randrange(20, 400):
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 9) + [rng.choice("abcde") for _ in range(rng.randrange(0, 4))]
        out += unit * rng.randrange(1, 6)
        if rng.random() < 0.3:
            del out[-rng.randrange(1, 6):]
        if rng.random() < 0.2:
            out.append(str(len(out)))
    return out


def numbers(words):
    n = {}
    return np.array([n.setdefault(x, len(n)) for x in words], np.int64)


@pytest.mark.parametrize("seed", range(6))
def test_structured_texts(seed):
    rng = random.Random(seed)
    texts = [structured(rng) for _ in range(150)]
    texts += [fibonacci(700), list("ab" * 200), ["x"] * 1000, ["x"] * 23, ["x"] * 24, list("abcdefgh") * 3, list("abcdefgh") * 3 + ["a"]]
    want = [brute(t) for t in texts]
    assert [periodic_runs.find_runs(numbers(t)) if t else [] for t in texts] == want
    assert periodic_runs.runs_of_texts([numbers(t) for t in texts]) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.integers(1, 12), st.lists(st.sampled_from("abc"), max_size=10), st.integers(1, 6))
def test_powers_of_powers(u, k, v, m):
    words = (u * k + v) * m
    assert periodic_runs.runs_of_texts([numbers(words)]) == [brute(words)]


def test_wrong_hashes_are_mended(monkeypatch):
    words = numbers(list("abcabd" * 9 + "xyz" * 12 + "q"))
    want = periodic_runs.find_runs(words)
    grow = periodic_runs.Extender._grow
    monkeypatch.setattr(periodic_runs.Extender, "_grow", lambda self, a, d, most, side: np.minimum(most, grow(self, a, d, most, side) + 2))
    assert set(want) <= set(periodic_runs.find_runs(words)) and want == brute(words.tolist())


def test_edge_cases(spark, docs):
    texts = [None, "", " \t\n ", "a", "x " * 24, "a b\tc\n" * 9, "é　é " * 30, "one two " * 20000, "a\x1cb " * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x " * 30), (4, "x " * 24), (4, "x " * 24)]
    df = docs(rows, "doc_id long, text string, runs string, collapsed string, id int").repartition(2)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, [tuple(x) for x in r["runs"]], r["collapsed"])
                  for r in periodic_runs.collapse_runs(df).collect()), key=str)
    want = []
    for d, t in rows:
        words = WORD.findall(t or "")
        runs = brute(words) if len(words) < 5000 else [(0, 40000, 2)]
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        want.append((d if d is not None else -1, runs, " ".join(kept)))
    assert got == sorted(want, key=str)
    assert periodic_runs.collapse_runs(docs([])).count() == 0
