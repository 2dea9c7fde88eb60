"""Context-tree weighting against a plain recursive version; unigram scores against brute force."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import catalog, ctw

from .conftest import SF


class Brute:
    """The tree as a dictionary of counts, scored bit by bit."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.kids = defaultdict(set)
        for t in texts:
            for ctx, prefix, bit in self.steps(t):
                for d in range(ctw.DEPTH + 1):
                    key = ctx[ctw.DEPTH - d:]
                    self.n[key, prefix][bit] += 1
                    if d:
                        self.kids[key[1:], prefix].add(key)
        self.memo = {}

    @staticmethod
    def steps(t):
        framed = b"\xff" * ctw.DEPTH + t + b"\xff"
        for i in range(ctw.DEPTH, len(framed)):
            for k in range(8):
                yield framed[i - ctw.DEPTH:i], (k, framed[i] >> 8 - k), framed[i] >> 7 - k & 1

    def own(self, key, prefix):
        a, b = self.n[key, prefix] if (key, prefix) in self.n else (0, 0)
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, key, prefix):
        if (key, prefix) not in self.memo:
            own = self.own(key, prefix)
            if len(key) < ctw.DEPTH:
                own = np.logaddexp(own, sum(self.weighted(k, prefix) for k in self.kids[key, prefix])) + math.log(0.5)
            self.memo[key, prefix] = own
        return self.memo[key, prefix]

    def one(self, ctx, prefix, d=0):
        key = ctx[ctw.DEPTH - d:]
        if (key, prefix) not in self.n:
            return 0.5
        a, b = self.n[key, prefix]
        p = (b + 0.5) / (a + b + 1)
        if d == ctw.DEPTH:
            return p
        w = math.exp(self.own(key, prefix) + math.log(0.5) - self.weighted(key, prefix))
        return w * p + (1 - w) * self.one(ctx, prefix, d + 1)

    def score(self, t):
        return sum(math.log10(p if bit else 1 - p) for ctx, prefix, bit in self.steps(t) for p in [self.one(ctx, prefix)])


TEXTS = ["abracadabra", "abra cadabra abra", "the cat sat on the mat", "", "the dog sat", "é à è", "zzz", "abc" * 50]


@pytest.mark.parametrize("most", [ctw.FREQUENT_GRAMS, 20])
def test_scores_match_the_recursive_tree(spark, docs, most):
    df = docs([(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, "QQ Unseen ÿ words"), (102, "the cat")]).repartition(3)
    got = {r["doc_id"]: r["score"] for r in ctw.score(df, F.col("doc_id") < 100, frequent=3, frequent_grams=most).collect()}
    tree = Brute([t.encode() for t in TEXTS])
    for i, t in [*enumerate(TEXTS), (100, ""), (101, "QQ Unseen ÿ words"), (102, "the cat")]:
        assert got[i] == pytest.approx(tree.score(t.encode()), abs=1e-4, rel=1e-5), t


def test_probabilities_sum_to_one_in_any_context():
    texts = [t.encode() for t in TEXTS]
    gram, n = ctw.gram_counts(texts)
    part = ctw.levels(gram, n)[-1].above(ctw.SPLIT - 1)
    top = [ctw.Level(*part)]
    for depth in range(ctw.SPLIT - 2, -1, -1):
        top.append(ctw.Level(*top[-1].above(depth)))
    top[-1].mix(0.0, 1.0)
    for i in range(len(top) - 2, -1, -1):
        top[i].mix(top[i + 1].base[top[i].up], top[i + 1].rest[top[i].up])
    for ctx in (b"abrac", b"the c", b"QQQQQ", b"QQQat", b"\xff" * ctw.DEPTH):
        query = (int.from_bytes(ctx[-ctw.DEPTH:], "big") << 8) + np.arange(256)
        assert np.isclose((10.0 ** ctw.gram_scores(query, gram, n, top[::-1])).sum(), 1)


def test_blocks_hold_whole_subtrees(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(ctw, "BLOCK_ROWS", 3)
    gram = np.repeat(np.arange(1, 9) << 8, [1, 5, 2, 7, 1, 1, 4, 3])
    batches = [pa.RecordBatch.from_arrays([pa.array(g), pa.array(g)], names=["gram", "n"]) for g in np.array_split(gram, 11)]
    out = list(ctw._blocks(iter(batches)))
    assert np.concatenate(out)[:, 0].tolist() == gram.tolist()
    assert all(a[-1, 0] != b[0, 0] for a, b in zip(out, out[1:]))


def test_unigram_columns_match_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    toks = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b""] for r in rows}
    held = {d: crc32(str(d).encode()) % 5 == 1 for d in toks}
    c = Counter(w for d, ws in toks.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in catalog.QUERIES["op5_ctw"](spark, SF).collect()}
    assert len(got) == len(rows)
    for d, ws in toks.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))


def test_edge_cases(docs):
    df = docs([(1, None), (1, None), (None, "x"), (2, "y " * 100_000)])
    got = ctw.score(df, F.lit(False)).collect()
    assert len(got) == 4 and {r["score"] for r in got if r["doc_id"] == 1} <= {8 * math.log10(0.5), *[r["score"] for r in got if abs(r["score"] - 8 * math.log10(0.5)) < 1e-6]}
    assert ctw.score(df.limit(0), F.lit(True)).count() == 0
    assert ctw.score(df, F.lit(True)).count() == 4
