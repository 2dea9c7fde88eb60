"""Decontamination against brute force, and its plan."""

import hashlib
import re

from ledgerlens.llm import decontaminate as D

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        for s in range(max(1, len(v) - 9) if v else 0):
            win = v[s:s + 10]
            for p in range(len(w) - len(win) + 1):
                if w[p:p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    ids.add("" if i is None else str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (10, "short one"), (2, None), (3, "!!"), (None, "Émile b c"),
         (1, "short one"), (4, "the the the the the the the the the the the"), (5, "a b c d e f g h i j")]
TEXTS = ["x Alpha, BETA gamma delta epsilon zeta eta theta iota kappa; lambda y", "alpha beta gamma delta epsilon zeta eta theta iota", "a SHORT-one b short one",
         "the " * 30, None, "", "Émile b c", "émile b c", "a b c d e f g h i j " * 3, "start a b c d e f g h i", "filler " * 60_000 + "short one", "short one"]


def test_report_matches_brute_force(spark, docs, monkeypatch):
    df = docs([(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (None, "short one")])
    items = spark.createDataFrame([(*x, "k") for x in ITEMS], "item_id long, text string, key string")
    for block in (D.BLOCK_WINDOWS, 2):
        monkeypatch.setattr(D, "BLOCK_WINDOWS", block)
        report = D.decontaminate_report(df, items)
        got = report.select("doc_id", "n_words", "n_hit", "n_items", D.items_digest(report["items"]).alias("sha")).collect()
        want = [(i, *brute(t, ITEMS)) for i, t in enumerate(TEXTS)] + [(2, *brute(TEXTS[2], ITEMS)), (None, *brute("short one", ITEMS))]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    clean = D.keep_clean(df, items)
    assert clean.columns == df.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, t in enumerate(TEXTS) if not brute(t, ITEMS)[1]]


def test_empty_tables(spark, docs):
    df = docs([(1, "a b c")])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.decontaminate_report(df.limit(0), items).count() == 0
    assert [r["n_hit"] for r in D.decontaminate_report(df, items.limit(0)).collect()] == [0]
    assert D.keep_clean(df, items.limit(0)).count() == 1


def test_no_python_in_the_plan(spark, docs):
    df = docs([(1, "a b c")])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = D.decontaminate_report(df, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
