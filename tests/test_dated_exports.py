"""F2 (round 4): documents travel once for the exports of a day, as one text; the files are those of the line operators."""

import glob
import gzip
import os
import random
import tempfile

from pyspark.sql import functions as F

from ledgerlens.operators import exports as X
from ledgerlens.plans import files
from tests.util import item, record, records_df


def odd_records(spark):
    rnd = random.Random(4)
    text = lambda: rnd.choice([None, "", "a", " b", 'q"', "x,y", "l\r\nm", "\x01", "\x02", "\x02a\x01", "a\x02b", "é"])      # noqa: E731
    num = lambda: rnd.choice([None, 2.0, 1e-7, 1e21, -0.5])      # noqa: E731
    recs = [record(invoice_number=text(), vendor=text(), po=text(), currency=text(), total=num(),
                   items=[item(description=text(), quantity=num(), unit_price=num(), amount=num()) for _ in range(rnd.randrange(4))],
                   flags=[{"severity": "info", "message": text() or "m"} for _ in range(rnd.randrange(3))]) for _ in range(120)]
    df = records_df(spark, recs).repartition(5)
    none = df.limit(1).withColumn("record", F.lit(None).cast(df.schema["record"].dataType)).withColumn("doc_id", F.lit("D0"))
    bare = df.limit(1).withColumn("record", F.expr("CASE WHEN order_key < 0 THEN record ELSE named_struct('invoice_number', record.invoice_number, "
                                  "'vendor', record.vendor, 'bill_date', record.bill_date, 'due_date', record.due_date, 'po_number', record.po_number, "
                                  "'subtotal', record.subtotal, 'tax', record.tax, 'total', record.total, 'currency', record.currency, "
                                  "'line_items', NULL, 'flags', NULL) END")).withColumn("doc_id", F.lit("D1"))
    return df.where("doc_id NOT IN ('D0', 'D1')").union(none).union(bare)


def whole(path, opened=open):
    return "".join(opened(p, "rt", newline="").read() for p in sorted(glob.glob(os.path.join(path, "part-*"))))


def test_files_hold_the_lines_of_each_format(spark):
    df, d = odd_records(spark).cache(), tempfile.mkdtemp(prefix="run-", dir="/tmp")
    by_doc = {r["doc_id"]: r["line"] for r in X.summary_lines(df).collect()}
    lines = sorted(((r["doc_id"], r["item_pos"] or 0, r["line"]) for r in X.line_item_lines(df).collect()))
    want = {"summary": [X.header_line(), *(by_doc[k] for k in sorted(by_doc))],
            "line_items": [X.header_line("line_items"), *(x[2] for x in lines)]}
    paths = X.write_exports(df, d, "2026-01-01")
    assert sorted(os.listdir(d)) == ["invoices-line_items-2026-01-01.csv", "invoices-summary-2026-01-01.csv"]
    for fmt, path in paths.items():
        assert whole(path) == "".join(x + "\r\n" for x in want[fmt])
        X.write_csv(df, os.path.join(d, "one"), fmt)
        assert whole(os.path.join(d, "one")) == whole(path)
    # another run of the day takes their place, in either encoding; other days stay
    X.write_exports(df, d, "2026-01-02")
    again = X.write_exports(df.where("doc_id = 'D7'"), d, "2026-01-01", compression="gzip")
    assert whole(again["summary"], gzip.open) == f"{X.header_line()}\r\n{by_doc['D7']}\r\n"
    assert len([x for x in os.listdir(d) if x.endswith('.csv')]) == 4 and not [x for x in os.listdir(d) if x.startswith('_')]
    X.write_exports(df.limit(0), d, "2026-01-03")
    assert whole(f"{d}/invoices-summary-2026-01-03.csv") == X.header_line() + "\r\n"


def test_documents_travel_once_as_one_text(spark, sf_small):
    seen = []
    given = X._texts
    X._texts = lambda *a: seen.append(given(*a)) or seen[-1]
    try:
        assert files.q_dated_exports(spark, sf_small).count() > 3000
    finally:
        X._texts = given
    assert len(seen) == 1
    shown = seen[0]._jdf.queryExecution().executedPlan().toString()
    moves = [x for x in shown.split("\n") if "Exchange rangepartitioning" in x]
    assert moves and "SinglePartition" not in shown
    ordered = seen[0]._jdf.queryExecution().optimizedPlan()
    while "RepartitionByExpression" not in ordered.nodeName():
        ordered = ordered.children().apply(ordered.children().size() - 1)
    assert [a.split("#")[0] for a in ordered.output().mkString(" ").split()] == ["doc_id", "text"]
