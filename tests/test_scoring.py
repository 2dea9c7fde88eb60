from ledgerlens import schemas as S
from ledgerlens.operators import scoring


def gt(**kw):
    base = {f: None for f in S.GROUND_TRUTH_FIELDS}
    base.update(kw)
    return base


def score(spark, expected: dict, actual: dict | None, error=None):
    cols = ["doc_id", "category", "error"] + [f"e_{f}" for f in S.GROUND_TRUTH_FIELDS] + \
        [f"a_{f}" for f in S.GROUND_TRUTH_FIELDS]
    actual = actual or gt()
    row = ["D1", "c", error] + [expected[f] for f in S.GROUND_TRUTH_FIELDS] + \
        [actual[f] for f in S.GROUND_TRUTH_FIELDS]
    schema = ", ".join(f"{c} {'double' if c[2:] in S.NUMBER_SCORED else 'string'}" for c in cols)
    df = spark.createDataFrame([tuple(row)], schema)
    docs = scoring.document_scores(df)
    fields = {r["field"]: r for r in scoring.field_scores(docs).collect()}
    return docs.collect()[0], fields


def test_string_trim_and_case(spark):
    d, f = score(spark, gt(invoice_number="INV-1", vendor_name="Acme Corp"),
                 gt(invoice_number="  inv-1 ", vendor_name="ACME CORP"))
    assert f["invoice_number"]["match"] and f["vendor_name"]["match"]


def test_null_expected_is_not_scored(spark):
    d, f = score(spark, gt(po_number=None), gt(po_number="PO-9"))
    assert f["po_number"]["match"] and d["passed"]


def test_actual_null(spark):
    d, f = score(spark, gt(po_number="PO-1"), gt(po_number=None))
    assert not f["po_number"]["match"] and f["po_number"]["note"] == "actual is null"
    assert not d["passed"]


def test_date_formats(spark):
    for raw in ("04/15/2026", "April 15, 2026", "15-Apr-2026"):
        _, f = score(spark, gt(bill_date="2026-04-15"), gt(bill_date=raw))
        assert f["bill_date"]["match"], raw
    _, f = score(spark, gt(bill_date="2026-04-15"), gt(bill_date="garbage"))
    assert not f["bill_date"]["match"]
    assert f["bill_date"]["note"] == "unparseable date: actual=garbage expected=2026-04-15"


def test_numeric_tolerance(spark):
    for a, ok in ((2167.559, True), (2167.561, True), (2167.58, False)):
        _, f = score(spark, gt(total=2167.56), gt(total=a))
        assert f["total"]["match"] is ok, a
    _, f = score(spark, gt(total=2167.56), gt(total=2167.58))
    assert f["total"]["note"] == "diff: 0.0200"


def test_whole_record_one_wrong(spark):
    e = gt(invoice_number="INV-1", vendor_name="Acme", bill_date="2026-04-01", due_date="2026-05-01",
           po_number="PO-1", subtotal=100.0, tax=8.0, total=108.0, currency="USD")
    a = dict(e, total=109.0)
    d, f = score(spark, e, a)
    assert d["n_fields"] == 9 and d["n_matched"] == 8 and d["n_failed"] == 1 and not d["passed"]


def test_errored_document(spark):
    d, f = score(spark, gt(total=1.0), gt(total=1.0), error="boom")
    assert d["n_fields"] == 0 and not d["passed"] and f == {}


def test_rollups_and_bottom(spark, sf_small):
    from ledgerlens.plans.evaluation import document_scores
    docs = document_scores(spark, sf_small).cache()
    overall = scoring.accuracy_overall(docs).collect()[0]
    by_cat = scoring.accuracy_by_category(docs).collect()
    assert overall["invoices"] == sum(r["invoices"] for r in by_cat)
    assert overall["matched"] == sum(r["matched"] for r in by_cat)
    roll = {(r["level"], r["name"]): r for r in scoring.accuracy_rollup(docs).collect()}
    assert roll[("overall", "all")]["total"] == overall["fields"]
    bottom = scoring.bottom_failures(docs).collect()
    assert len(bottom) <= 15
    keys = [(-r["failed_fields"], r["doc_id"]) for r in bottom]
    assert keys == sorted(keys)
