from ledgerlens.operators import edits as E
from ledgerlens.operators import validation as V
from tests.util import item, record, records_df

AS_OF = "2026-06-01"


def flags_of(spark, rec):
    df = V.with_rule_flags(records_df(spark, [rec]), AS_OF)
    r = df.collect()[0]
    return [(f["rule"], f["severity"], f["message"]) for f in r["det_flags"]], \
        [(f["severity"], f["message"]) for f in r["merged_flags"]]


def test_clean_invoice_has_no_flags(spark):
    det, merged = flags_of(spark, record())
    assert det == [] and merged == []


def test_math_mismatch(spark):
    det, _ = flags_of(spark, record(total=200.0))
    assert det == [("V1", "error", "Math doesn't add up: subtotal ($100.00) + tax ($8.00) = $108.00, "
                                   "but total is $200.00.")]


def test_within_tolerance(spark):
    det, _ = flags_of(spark, record(total=108.01))
    assert det == []


def test_line_items_do_not_sum(spark):
    det, _ = flags_of(spark, record(items=[item(amount=30.0), item(amount=30.0)]))
    assert det == [("V2", "warning", "Line items sum to $60.00, but subtotal is $100.00.")]


def test_null_amount_counts_zero(spark):
    det, _ = flags_of(spark, record(items=[item(amount=100.0), item(amount=None)]))
    assert det == []


def test_total_zero(spark):
    det, _ = flags_of(spark, record(subtotal=0.0, tax=0.0, total=0.0))
    assert [d[0] for d in det] == ["V3"]
    assert det[0][2] == "Total is $0.00, expected a positive value."


def test_due_before_bill(spark):
    det, _ = flags_of(spark, record(bill="2026-04-10", due="2026-04-01"))
    assert det == [("V4", "error", "Due date (2026-04-01) is before bill date (2026-04-10).")]


def test_bill_in_future(spark):
    det, _ = flags_of(spark, record(bill="2026-07-01", due="2026-08-01"))
    assert det == [("V5", "warning", "Bill date (2026-07-01) is in the future.")]


def test_vendor_missing_null_or_empty(spark):
    for v in (None, ""):
        det, _ = flags_of(spark, record(vendor=v))
        assert det == [("V6", "warning", "Vendor name could not be extracted.")]


def test_unparseable_dates_skipped(spark):
    det, _ = flags_of(spark, record(bill="soon", due="later"))
    assert det == []


def test_merge_order_and_dedupe(spark):
    model = [{"severity": "info", "message": "Currency could not be determined."},
             {"severity": "warning", "message": "Vendor name could not be extracted."},
             {"severity": "info", "message": "Currency could not be determined."}]
    det, merged = flags_of(spark, record(vendor=None, total=200.0, flags=model))
    assert [d[0] for d in det] == ["V1", "V6"]
    assert merged == [("error", det[0][2]), ("warning", "Vendor name could not be extracted."),
                      ("info", "Currency could not be determined.")]


def test_confidence_counts(spark):
    df = records_df(spark, [record(confidence="medium")])
    r = df.selectExpr(*V.confidence_counts_sql()).collect()[0]
    assert (r["high"], r["medium"], r["low"]) == (0, 9, 0)


def test_edit_overlay_revalidates(spark):
    recs = records_df(spark, [record(total=200.0, vendor=None,
                                     flags=[{"severity": "info", "message": "model note"}])])
    edits = spark.createDataFrame([("D0", "total", " 1,08.00 ", 1, 0), ("D0", "total", "abc", 2, 1),
                                   ("D0", "vendor_name", "  Acme  ", 1, 2)],
                                  "doc_id string, field string, raw string, ts long, seq long")
    ed = E.apply_edits(recs, edits)
    r = E.with_display_flags(ed, AS_OF).selectExpr("edited.total.value AS t", "edited.vendor.name AS v", "edited_fields", "flags").collect()[0]
    assert r["t"] == 108.0 and r["v"] == "Acme" and r["edited_fields"] == 2
    assert [(f["severity"], f["message"]) for f in r["flags"]] == [("info", "model note")]


def test_dates_in_other_forms(spark):
    for bill, due in (("04/15/2026", "April 1, 2026"), ("15-Apr-2026", "04/01/2026"), ("April 15 2026", "2026-04-01")):
        det, _ = flags_of(spark, record(bill=bill, due=due))
        assert det == [("V4", "error", f"Due date ({due}) is before bill date ({bill}).")]
    det, _ = flags_of(spark, record(bill="July 1, 2026", due="02/30/2027"))
    assert [d[0] for d in det] == ["V5"]


def test_unedited_records_stay(spark):
    recs = records_df(spark, [record(), record(vendor=None)])
    edits = spark.createDataFrame([("D0", "po_number", "  ", 1, 0)], "doc_id string, field string, raw string, ts long, seq long")
    ed = E.apply_edits(recs, edits)
    assert {r["doc_id"]: (r["po"], r["edited_fields"]) for r in ed.selectExpr("doc_id", "edited.po_number.value AS po", "edited_fields").collect()} == \
        {"D0": (None, 1), "D1": ("PO-1", 0)}
    marks = E.edited_markers(ed).collect()
    assert len(marks) == 18 and [(r["doc_id"], r["field"]) for r in marks if r["edited"]] == [("D0", "po_number")]
