"""Result folders keep earlier runs; every document keeps a tenant, whatever gaps the conversations have; prompts of every kind."""

import base64
import os
import tempfile

from ledgerlens.operators import custom_fields as CF
from ledgerlens.operators import exports as X
from ledgerlens.operators import reports as R
from ledgerlens.plans import evaluation as E
from ledgerlens.plans import intake as P
from tests.util import record, records_df


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_results_of_two_dates_and_a_rerun(spark, sf_small):
    docs = E.document_scores(spark, sf_small).where("doc_id LIKE 'INV-1%'").cache()
    d = folder()
    R.write_results(docs, d, "2026-01-01")
    R.write_results(docs.where("doc_id LIKE 'INV-10%'"), d, "2026-01-02")
    R.write_results(docs.where("doc_id LIKE 'INV-11%'"), d, "2026-01-02")       # the same date again replaces it
    got = spark.read.json(d)
    n = {str(r["run_date"]): r["count"] for r in got.groupBy("run_date").count().collect()}
    assert n == {"2026-01-01": docs.count(), "2026-01-02": docs.where("doc_id LIKE 'INV-11%'").count()}
    recs = records_df(spark, [record()]).withColumnRenamed("record", "edited")
    e = folder()
    for day in ("2026-01-01", "2026-01-02"):
        R.write_records(recs, e, day)
    assert spark.read.json(e).count() == 2


def test_dated_exports_stand_side_by_side(spark):
    d, recs = folder(), records_df(spark, [record(), record(invoice_number="INV-2")])
    paths = [X.write_export(recs, d, day, fmt) for day in ("2026-01-01", "2026-01-02") for fmt in ("summary", "line_items")]
    assert sorted(os.listdir(d)) == sorted(os.path.basename(p) for p in paths) and len(set(paths)) == 4
    assert os.path.basename(paths[0]) == "invoices-summary-2026-01-01.csv"
    assert spark.read.text(paths[0]).count() == 3


def tables(spark, sf, conversations):
    d = folder()
    for t in ("orders", "lineitem", "part", "customer", "supplier", "nation", "region"):
        os.symlink(f"{sf}/{t}.parquet", f"{d}/{t}.parquet")
    spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def test_no_document_is_lost_in_gaps(spark, sf_small):
    docs = spark.range(40).selectExpr("concat('D', id) AS doc_id", "id AS order_key")
    gaps = [(7, 0, "u", "one two three"), (7, 5, "u", "four five"), (19, 2, "u", None), (900, 1, "u", "six seven eight"), (900, 1, "u", "again")]
    dealt = P.document_tenants(spark, tables(spark, sf_small, gaps), docs).collect()
    assert len(dealt) == 40
    keys = sorted({g[:2] for g in gaps})
    assert {r["order_key"]: (r["conv_id"], r["turn"]) for r in dealt} == {i: keys[i % len(keys)] for i in range(40)}
    none = P.document_tenants(spark, tables(spark, sf_small, []), docs).collect()
    assert len(none) == 40 and all(r["conv_id"] is None for r in none)


def test_prompts_are_kept_without_conversations(spark, sf_small):
    n = spark.read.parquet(f"{sf_small}/orders.parquet").count()
    assert P.q_prompt_rows(spark, tables(spark, sf_small, [(3, 9, "u", "a field here, another one there")])).count() == n


def test_prompt_parts(spark):
    rows = [(k, "text body", "image/png", bytearray(range(256))) for k in ("text", "image", "pdf", "error")]
    df = spark.createDataFrame(rows, "kind string, t string, mime string, content binary")
    got = {r["kind"]: r["p"] for r in df.selectExpr("kind", f"{CF.prompt_parts_sql('kind', 't', 'mime', 'content', repr('2026-01-01'), repr('+block'))} AS p").collect()}
    assert got["error"] is None and len(got["text"]) == 1 and got["text"][0]["text"].endswith(CF.PROMPT_INSTRUCTION + "+block")
    for kind, t, mime, asked in (("image", "image", "image/png", CF.IMAGE_INSTRUCTION), ("pdf", "document", "application/pdf", CF.PDF_INSTRUCTION)):
        file, text = got[kind]
        assert (file["type"], file["media_type"]) == (t, mime) and base64.b64decode(file["data"]) == bytes(range(256)) and "\n" not in file["data"]
        assert text["text"] == f"<today>2026-01-01</today>\n\n{asked}+block"


def test_staged_definition_check_equals_the_expressions(spark):
    lists = ['[]', '{}', 'x', None, '[1]', '[{"id":"a","name":"n","type":"number","description":"12345"}]',
             '[{"id":5,"name":"n","type":"number","description":"12345"}]', '[{"id":"a","name":"n","type":"other","description":"12345"}]',
             '[' + ','.join('{"id":"a%d","name":"n","type":"date","description":"12345"}' % i for i in range(11)) + ']']
    df = spark.createDataFrame([(x,) for x in lists], "j string")
    c = CF.check_definitions_sql("j")
    want = [tuple(r) for r in df.selectExpr("j", f"{c['defs']} AS defs", f"{c['reason']} AS reason").collect()]
    assert [tuple(r) for r in CF.check_definitions(df, "j").collect()] == want
