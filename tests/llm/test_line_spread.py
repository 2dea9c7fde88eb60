"""Line spread: the query against SQL-like counting, edge cases."""

from ledgerlens.llm import line_spread


def test_lines_on_many_sites_go(docs):
    rows = [(i, f"own {i}\n  shared line\t\n\nfew" if i < 4 else f"own {i}\nshared line\nlast", None, f"s{i}") for i in range(6)]
    rows += [(20 + i, "one site only", None, "s0") for i in range(9)] + [(40, None), (41, ""), (0, rows[0][1], None, "s0")]
    df = docs(rows)
    out = line_spread.remove_spread_lines(df)
    assert [c for c in out.columns if c != "spread"] == df.columns
    got = {(r["doc_id"], r["source"]): r for r in out.collect()}
    assert out.count() == len(rows)
    assert got[0, "s0"]["text"] == "own 0\n\nfew" and got[0, "s0"]["spread"]["n_removed"] == 1 and got[0, "s0"]["spread"]["n_lines"] == 4
    assert got[5, "s5"]["text"] == "own 5\nlast" and got[20, "s0"]["text"] == "one site only" and got[40, None]["text"] == ""
    assert line_spread.remove_spread_lines(df.limit(0)).count() == 0


def test_threshold_is_exact(spark):
    rows = [(h, f"site{k}") for h in range(40) for k in range(h)] * 2 + [(99, None)] * 9
    df = spark.createDataFrame(rows, "h long, site string").repartition(4)
    for least in (5, 20):
        assert {r["h"] for r in line_spread.line_spread(df, least).collect()} == set(range(least, 40))


def test_clashing_columns_are_replaced(spark):
    rows = [(i, f"own {i}\nshared line", f"s{i}", "x") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, spread string")
    out = line_spread.remove_spread_lines(df)
    assert out.columns == ["doc_id", "text", "source", "spread"]
    assert {(r["doc_id"], r["text"], r["spread"]["n_removed"]) for r in out.collect()} == {(i, f"own {i}", 1) for i in range(12)}


def test_long_documents_keep_their_order(spark):
    rows = [(i, "\n".join(["shared line" if j % 3 == 0 else f"own {i} {j}" for j in range(3000)]), f"s{i}") for i in range(6)]
    out = line_spread.remove_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(i, "\n".join(f"own {i} {j}" for j in range(3000) if j % 3)) for i in range(6)}
