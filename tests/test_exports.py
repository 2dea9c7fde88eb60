import os
import tempfile

from ledgerlens.operators import exports as X
from tests.util import item, record, records_df


def test_summary_line_escaping_and_memo(spark):
    rec = record(vendor='Acme, "Inc"', subtotal=2007.0, tax=0.0, total=2007.0,
                 items=[item(description="a"), item(description=None), item(description=""),
                        item(description=" b")],
                 flags=[{"severity": "warning", "message": "x"}, {"severity": "info", "message": "y"}])
    line = X.summary_lines(records_df(spark, [rec])).collect()[0]["line"]
    assert line == ('INV-1,"Acme, ""Inc""",1 Main St,2026-04-01,2026-05-01,PO-1,2007,0,2007,USD,'
                    'a |  b,warning: x; info: y')


def test_line_items_repeat_header_and_empty(spark):
    recs = [record(items=[item(description="a", quantity=2.0, unit_price=1.5, amount=3.0), item(description="b")]),
            record(invoice_number="INV-2", items=[])]
    rows = sorted((r["doc_id"], r["item_pos"], r["line"]) for r in X.line_item_lines(records_df(spark, recs)).collect()
                  if r["item_pos"] is not None) + \
        [(r["doc_id"], r["item_pos"], r["line"]) for r in X.line_item_lines(records_df(spark, recs)).collect()
         if r["item_pos"] is None]
    assert rows[0][2] == "INV-1,Acme,2026-04-01,2026-05-01,108,USD,a,2,1.5,3"
    assert rows[1][2].startswith("INV-1,Acme,") and rows[1][2].endswith(",b,1,10,10")
    assert rows[2] == ("D1", None, "INV-2,Acme,2026-04-01,2026-05-01,108,USD,,,,")


def test_header_and_sink(spark):
    assert X.header_line() == ("invoice_number,vendor_name,vendor_address,bill_date,due_date,po_number,"
                               "subtotal,tax,total,currency,memo,flags")
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    X.write_csv(records_df(spark, [record(), record(invoice_number="INV-2")]), os.path.join(d, "out"))
    parts = sorted(f for f in os.listdir(os.path.join(d, "out")) if f.startswith("part-"))
    text = "".join(open(os.path.join(d, "out", p), newline="").read() for p in parts)
    rows = text.split("\r\n")
    assert rows[0] == X.header_line() and rows[1].startswith("INV-1,") and rows[2].startswith("INV-2,")


def test_redaction_and_payload(spark):
    df = records_df(spark, [record(items=[item()])])
    p = X.webhook_payloads(df).collect()[0]
    assert '"reasoning"' not in p["payload"] and '"idempotency_key":null' in p["payload"]
    assert p["confidence_summary"]["high"] == 9
    v = X.webhook_payloads(df, verbose=True).collect()[0]
    assert '"reasoning"' in v["payload"]
    assert len(p["correlation_id"]) == 36
