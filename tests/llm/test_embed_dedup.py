"""Embedding near-dedup against brute force."""

import numpy as np

from ledgerlens.llm import embed_dedup


def brute(rows, threshold=0.93):
    n = len(rows)
    ok = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, lab, v in rows]
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = np.array(rows[i][2]), np.array(rows[j][2])
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], low[find(i)], rows[i][0] == low[find(i)]) for i in range(n))


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, v string").repartition(3)
    out = embed_dedup.near_duplicates(df)
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect())


def test_cells_and_blocks_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        base = rng.normal(size=8) if i % 3 == 0 or not rows else np.array(rows[-1][2]) + rng.normal(size=8) * 0.2
        rows.append((i, int(i % 2), [float(np.float32(x)) for x in base]))
    rows += [(300 + i, 0, rows[0][2]) for i in range(40)]         # copies
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(embed_dedup, "CELL_TARGET", 30)
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    assert run(spark, rows) == want


def test_edge_cases(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, 0, None), (5, 0, []), (6, 0, [0.0, 0.0]),
            (7, 0, [float("nan"), 1.0]), (8, 0, [None, 1.0]), (9, 0, [float("inf"), 1.0]), (10, 0, [1.0, 0.0, 0.0]), (11, 1, [1.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert embed_dedup.near_duplicates(df).count() == 0
    null_id = spark.createDataFrame([(None, 0, [1.0]), (4, 0, [2.0])], "vec_id long, label int, embedding array<float>")
    assert {r["component_id"] for r in embed_dedup.near_duplicates(null_id).collect()} == {4}


def test_huge_and_tiny_components_keep_their_links(spark):
    rows = [(1, 0, [1e200, 2e200]), (2, 0, [1.0, 2.0]), (3, 0, [1e-200, 2e-200]), (4, 0, [2e200, -1e200]), (5, 0, [0.0, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}
