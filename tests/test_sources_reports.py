import json
import os
import tempfile

from pyspark.sql import functions as F

from ledgerlens.operators import custom_fields as CF
from ledgerlens.operators import evidence as EV
from ledgerlens.operators import extraction as X
from ledgerlens.operators import reports as R
from ledgerlens.schemas import GROUND_TRUTH_FIELDS
from ledgerlens.sources.fixtures import read_corpus
from ledgerlens.sources.sse import parse_sse


def _fixture(root, name, expected=True, meta=True, doc=True, cat="retail"):
    d = os.path.join(root, name)
    os.makedirs(d)
    if expected:
        json.dump({"invoice_number": name, "vendor_name": "V", "bill_date": "2026-01-01", "due_date": None,
                   "po_number": None, "subtotal": 3750, "tax": 0, "total": 3750, "currency": "USD"},
                  open(os.path.join(d, "expected.json"), "w"), indent=2)
    if meta:
        json.dump({"id": name, "category": cat, "source": "synthetic"}, open(os.path.join(d, "meta.json"), "w"))
    if doc:
        open(os.path.join(d, "invoice.pdf"), "wb").write(b"%PDF-1.4 x")


def test_corpus_scan(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    _fixture(root, "s002")
    _fixture(root, "s001")
    _fixture(root, "s003", meta=False)
    _fixture(root, "s004", doc=False)
    fx, skipped = read_corpus(spark, root)
    rows = fx.collect()
    assert [r["id"] for r in rows] == ["s001", "s002"]
    assert rows[0]["subtotal"] == 3750.0 and rows[0]["due_date"] is None
    assert {r["folder"]: r["missing"] for r in skipped.collect()} == {"s003": "meta.json", "s004": "document"}


def test_reports(spark, sf_small):
    from ledgerlens.plans.evaluation import document_scores
    docs = document_scores(spark, sf_small)
    acc = R.accuracy_report(docs)
    assert [r["name"] for r in acc.where("section = 'field'").orderBy("ordinal").collect()] == list(GROUND_TRUTH_FIELDS)
    fail = R.failure_report(docs, 3)
    assert fail.where("section = 'failure'").select("name").distinct().count() == 3
    assert fail.where("section = 'error'").count() == docs.where("error IS NOT NULL").count()
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    R.write_results(docs, os.path.join(out, "res"), "2026-01-01")
    assert spark.read.json(os.path.join(out, "res")).filter("run_date = '2026-01-01'").count() == docs.count()
    R.write_report(fail, os.path.join(out, "fail"))
    got = [json.loads(x) for p in sorted(os.listdir(os.path.join(out, "fail"))) if p.startswith("part-") for x in open(os.path.join(out, "fail", p))]
    assert len(got) == fail.count() and [g["section"] for g in got] == sorted(g["section"] for g in got)
    from ledgerlens.operators.exports import header_line, write_csv
    from ledgerlens.sources.invoices import invoice_records
    for fmt in ("summary", "line_items"):
        write_csv(invoice_records(spark, sf_small).where("order_key < 40"), os.path.join(out, fmt), fmt)
        text = "".join(open(os.path.join(out, fmt, p), newline="").read() for p in sorted(os.listdir(os.path.join(out, fmt))) if p.startswith("part-"))
        assert text.split("\r\n")[0] == header_line(fmt) and text.count(header_line(fmt)) == 1


def test_box_normalisation(spark):
    b = EV.normalise_box_sql("50D", "120D", "1D", "2D", "0D", "10D", "2D", "100D", "200D")
    r = spark.range(1).selectExpr(*[f"{v} AS {k}" for k, v in b.items()]).collect()[0]
    assert (r["x"], r["y"], r["w"], r["h"]) == (0.5, 0.55, 0.04, 0.05)


def test_extraction_schema():
    s = CF.extraction_schema([{"id": "a", "type": "number"}, {"id": "b", "type": "date"}])
    cf = s["custom_fields"].dataType
    assert cf["a"].dataType["value"].dataType.typeName() == "double"
    assert cf["b"].dataType["value"].dataType.typeName() == "string"


def test_pluggable_extractor(spark):
    import pandas as pd
    docs = spark.createDataFrame([("d1", "Invoice Number: A-1\nTotal: 5.00")], "doc_id string, text string")

    def fake_model(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pdf["doc_id"], "invoice_number": ["A-1"] * len(pdf)})
    out = X.extract_with(docs, fake_model, "doc_id string, invoice_number string").collect()
    assert out[0]["invoice_number"] == "A-1"


def test_sse(spark):
    text = "event: field\ndata: {\"a\":1}\n\ndata: x\n\n\n\nevent: a\nevent: b \ndata: 1\ndata: 2\n\nevent: e\ndata: par"
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = [(r["event"], r["data"]) for r in parse_sse(df).orderBy("pos").collect()]
    assert got == [("field", '{"a":1}'), ("message", "x"), ("b", "2")]
    assert parse_sse(df).first()["remainder"] == "event: e\ndata: par"


def test_definition_values_must_be_strings(spark):
    c = CF.check_definitions_sql("j")
    rows = ['[{"id":"a","name":5,"type":"string","description":"12345"}]', '[{"id":"a","name":"n","type":"string","description":"12345"}]',
            '{"id":"a"}', "5", "nope", "[]", '[{"id":"a","name":"n","type":"string"}]', "[null]", None]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    assert [r[0] for r in df.selectExpr(f"{c['reason']} AS r").collect()] == \
        ["invalid-entry", None, "non-array", "non-array", "non-array", None, "invalid-entry", "invalid-entry", "non-array"]


def test_present_null_is_shown(spark):
    defs = spark.createDataFrame([("t", 0, "a", " A "), ("t", 1, "b", "B")], "tenant string, pos int, id string, name string")
    values = spark.createDataFrame([("d", "t", "a", None)], "doc_id string, tenant string, id string, value string")
    assert [tuple(r) for r in CF.display_values(defs, values).collect()] == [("d", 0, "A", None)]
    assert CF.value_map(values).first()["custom_fields"] == {"a": None}
