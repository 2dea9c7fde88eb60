"""SimHash: fingerprints and groups against brute force."""

import random

import pytest
import xxhash

from ledgerlens.llm import catalog, simhash

from .conftest import SF


def brute_fp(text):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(pairs):
    """doc -> smallest doc reachable; links at 3 or fewer bits."""
    root = {d: d for d, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, f) in enumerate(pairs):
        for b, g in pairs[:i]:
            if (f ^ g).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = [(r["doc_id"], brute_fp(r["text"])) for r in rows]
    want = brute_groups(fps)
    got = {r["doc_id"]: r for r in catalog.QUERIES["op1_simhash"](spark, SF).collect()}
    assert len(got) == len(rows)
    for d, f in fps:
        assert got[d]["fingerprint"] == f"{f:016x}"
        assert got[d]["component_id"] == want[d]


def test_grid_finds_all_links(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base[:30]:
        x = b
        for _ in range(6):                  # chains of near fingerprints
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
            fps.add(x)
    for i in range(64):                     # a dense ball
        fps.add(base[0] ^ 1 << i)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute_groups([(s, s & (1 << 64) - 1) for s in sorted(signed)])
    df = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(3)
    for block in (simhash.CELL_BLOCK, 4):   # also with every cell dealt out as blocks
        old, simhash.CELL_BLOCK = simhash.CELL_BLOCK, block
        try:
            got = {r["fp"]: r["root"] for r in simhash.fingerprint_groups(df).collect()}
        finally:
            simhash.CELL_BLOCK = old
        assert got == want


def test_edge_cases(docs):
    text = "one two three four five six seven eight nine ten"
    df = docs([(3, text), (1, None), (2, ""), (2, ""), (5, text.upper()), (None, text), (4, " \t\n"), (6, "A b"), (7, "word " * 50_000)])
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 9
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    zero = "0" * 16
    assert [by[i]["fingerprint"] for i in (1, 2, 4)] == [zero] * 3 and by[4]["component_id"] == 1
    assert by[5]["component_id"] == 3 and by[6]["fingerprint"] == f"{brute_fp('a b'):016x}"
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [3]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_distance_is_bounded(spark):
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.createDataFrame([(1,)], "fp long"), 4)
