from pyspark.sql import functions as F

from ledgerlens.operators import evidence as EV
from ledgerlens.operators import extraction as X
from tests.util import record, records_df


def test_date_and_money_variants(spark):
    r = spark.range(1).select(F.expr(EV.date_variants_sql("'2026-04-05'")).alias("d"),
                              F.expr(EV.money_variants_sql("1234.5D")).alias("m"),
                              F.expr(EV.word_fallbacks_sql("'Acme Supply Co'")).alias("w"),
                              F.expr(EV.date_variants_sql("'5 April'")).alias("o")).collect()[0]
    assert r["d"] == ["2026-04-05", "April 5, 2026", "Apr 5, 2026", "04/05/2026", "05/04/2026", "April 5"]
    assert r["m"] == ["1,234.50", "1234.50"] and r["w"] == ["Acme Supply Co", "Acme", "Supply"]
    assert r["o"] == ["5 April"]


def _brute(lines, variants):
    for vn, v in enumerate(variants):
        t = v.strip()
        if len(t) < 2:
            continue
        for ln, s in enumerate(lines):
            if t.lower() in s.lower():
                return vn, ln
    return None


def test_lookup_matches_brute_force(spark):
    recs = records_df(spark, [record(vendor="Acme Supply Co", total=1234.5), record(invoice_number="X9")])
    texts = X.render_text(recs)
    got = {(r["doc_id"], r["label"]): (r["variant_no"], r["line_no"])
           for r in EV.lookup(EV.field_variants(recs), texts).collect()}
    tx = {r["doc_id"]: r["text"].split("\n") for r in texts.collect()}
    vs = {}
    for r in EV.field_variants(recs).collect():
        vs |= {(r["doc_id"], lb["label"]): lb["vs"] for lb in r["labels"]}
    assert len(vs) == 18
    for (doc, label), lst in vs.items():
        assert got.get((doc, label)) == _brute(tx[doc], lst), (doc, label)


def test_render_and_rule_extract(spark):
    recs = records_df(spark, [record(po=None)])
    t = X.render_text(recs)
    row = t.selectExpr(*[f"{v} AS {k}" for k, v in X.rule_extract_sql("text").items()]).collect()[0]
    assert row["invoice_number"] == "INV-1" and row["po_number"] is None and row["total"] == 108.0
    assert row["vendor_name"] == "Acme" and row["tax"] == 8.0


def test_bbox(spark):
    cases = ["[bbox: 0.1, 0.2, 0.3, 0.4] Found", "[BBOX: none] x", "[bbox: 1.5, 0, 0, 0] y", "plain",
             "[bbox: a, 0, 0, 0] z"]
    df = spark.createDataFrame([(c,) for c in cases], "r string")
    b = X.bbox_sql("r")
    got = [tuple(r) for r in df.selectExpr(b["x"], b["h"], b["text"]).collect()]
    assert got == [(0.1, 0.4, "Found"), (None, None, "x"), (None, None, "y"), (None, None, "plain"),
                   (None, None, "[bbox: a, 0, 0, 0] z")]


def test_staged_boxes_equal_the_expressions(spark):
    from ledgerlens.operators import extraction as X
    texts = ["[bbox: 0.1, 0.2,0.3 , 0.4] a", "[bbox:0,0,1,1]", "[BBOX: 0,0,1,1] x", "[bbox: none] n", "[BBOX: None]  m", "[bbox: 1.5, 0, 0, 0] big", "[bbox: -, 1, 1, 1] bad",
             "[bbox: 1.2.3, 0, 0, 0] odd", "plain", "", None, " [bbox: 0,0,0,0] late", "[bbox: 0, 0, 0] three", "[bbox: -0.05, .5, 1., 0] edge"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, r string")
    b = X.bbox_sql("r")
    want = [tuple(r) for r in df.selectExpr("i", "r", *[f"{b[n]} AS {n}" for n in ("x", "y", "w", "h", "text")]).collect()]
    assert [tuple(r) for r in X.with_boxes(df, "r").collect()] == want
