"""Event streams cut anywhere, typed custom fields, deliveries with commit and abort, latency sketches, evidence over items."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import custom_fields as CF
from ledgerlens.operators import delivery as D
from ledgerlens.operators import errors as ER
from ledgerlens.operators import evidence as EV
from ledgerlens.operators.chunks import record_json_sql
from ledgerlens.sources.sse import parse_sse
from ledgerlens.streaming.sse import stream_sse
from tests.util import record, records_df


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


TEXTS = {
    "a": "event: progress\ndata: 1\n\nevent: field\ndata: x\n\n\n\ndata: only\n\nevent:  y \nevent: z \ndata: p\ndata: q\n\nevent: cut",
    "b": "data: {\"k\": \"é\\n\"}\n\n: comment\n\nevent: none\n\n \n\ndata: \n\ndata: end\n\n", "c": "", "d": "no end", "e": "\n\n\n\n\n",
}


def test_pieces_cut_anywhere(spark):
    schema = "response_id string, seq long, piece string, last boolean"
    want = {tuple(r) for r in parse_sse(spark.createDataFrame(list(TEXTS.items()), "response_id string, text string"), keep=("response_id",))
            .select("response_id", "pos", "event", "data").collect()}
    for seed in (1, 2):
        rng, rows = random.Random(seed), []
        for rid, text in TEXTS.items():
            cuts = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, 12))) if len(text) > 1 else []
            pieces = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]
            rows += [(rid, i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
        rng.shuffle(rows)
        d = folder()
        for k in range(3):
            part = rows[k::3] + rows[:5]                    # some pieces come again
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(os.path.join(d, "in", f"p{k}"))
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(os.path.join(d, "in"))
        q = (stream_sse(src).writeStream.format("parquet").option("path", os.path.join(d, "out"))
             .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
        q.awaitTermination(300)
        got = [tuple(r) for r in spark.read.parquet(os.path.join(d, "out")).select("response_id", "pos", "event", "data").collect()]
        assert len(got) == len(want) and set(got) == want


DEFS = [{"id": "n", "name": "N", "type": "number"}, {"id": "s'1", "name": "S", "type": "string"}, {"id": "d", "name": "D", "type": "date"}]


def field(value, confidence="high", reasoning="r"):
    return {"value": value, "confidence": confidence, "reasoning": reasoning}


CASES = [
    ({"n": field(1.5), "s'1": field("x"), "d": field("2026-01-01")}, None), ({"n": field(None), "s'1": field(None), "d": field(None)}, None),
    ({"n": field("1.5"), "s'1": field("x"), "d": field("y")}, "wrong-type"), ({"n": field(1), "s'1": field(7), "d": field("y")}, "wrong-type"),
    ({"n": field(1), "s'1": field("x")}, "missing-key"), ({"n": field(1), "s'1": field("x"), "d": field("y", "sure")}, "bad-enum"),
    ({"n": 4, "s'1": field("x"), "d": field("y")}, "wrong-type"), ({"n": field(1), "s'1": {"value": "x", "confidence": "low"}, "d": field("y")}, "missing-key"),
    ({"n": field(True), "s'1": field("x"), "d": field("y")}, "wrong-type"), (None, "missing-key"),
]


def test_responses_are_read_by_their_definitions(spark):
    base = json.loads(records_df(spark, [record()]).selectExpr(f"{record_json_sql()} AS v").first()["v"])
    rows = [(i, json.dumps(base | ({"custom_fields": c} if c is not None else {}))) for i, (c, _) in enumerate(CASES)] + [(99, "{oops")]
    df = spark.createDataFrame(rows, "i int, value string")
    got = {r["i"]: r for r in CF.read_extractions(df, DEFS).collect()}
    assert {i: got[i]["error"] for i in got} == {i: e for i, (_, e) in enumerate(CASES)} | {99: "invalid-json"}
    fields = got[0]["record"]["custom_fields"]
    assert (fields["n"]["value"], fields["s'1"]["value"], fields["d"]["value"]) == (1.5, "x", "2026-01-01") and got[2]["record"] is None
    assert got[0]["record"]["invoice_number"]["value"] == "INV-1"
    defs = spark.createDataFrame([("t", i, d["id"], d["type"]) for i, d in enumerate(DEFS)] + [("other", 0, "n", "string")], "tenant string, pos int, id string, type string")
    long = CF.typed_values(df.selectExpr("CAST(i AS STRING) AS doc_id", "'t' AS tenant", "value AS response"), defs).collect()
    assert len(long) == 3 * len(rows)
    by = {(r["doc_id"], r["id"]): (r["number_value"], r["text_value"], r["reason"]) for r in long}
    assert by["0", "n"] == (1.5, None, None) and by["0", "d"] == (None, "2026-01-01", None) and by["2", "n"] == (None, None, "wrong-type")
    assert by["4", "d"] == (None, None, "missing-key") and by["5", "d"][2] == "bad-enum" and by["99", "n"][2] == "invalid-json" and by["1", "n"] == (None, None, None)


def test_each_key_is_delivered_once(spark):
    d = folder()
    df = spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(20)] + [("k3", "again")], D.SCHEMA).repartition(3)
    D.deliver(df, d)
    D.deliver(df.union(spark.createDataFrame([("new", None)], D.SCHEMA)), d)
    got = sorted(r["idempotency_key"] for r in D.read_deliveries(spark, d).collect())
    assert got == sorted([*(f"k{i}" for i in range(20)), "new"])


def test_a_failed_batch_leaves_nothing_and_can_run_again(spark):
    d = folder()
    good = spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(9)], D.SCHEMA)
    bad = good.repartition(3).withColumn("payload", F.expr("CASE WHEN idempotency_key = 'k4' THEN raise_error('stop') ELSE payload END"))
    with pytest.raises(Exception):
        D.deliver(bad, d)
    assert D.read_deliveries(spark, d).count() == 0
    D.deliver(good, d)
    assert D.read_deliveries(spark, d).count() == 9
    keyless = spark.createDataFrame([(None, "x"), (None, "x")], D.SCHEMA)
    D.deliver(keyless, d)
    assert D.read_deliveries(spark, d).count() == 11


def test_latency_percentiles_keep_their_bound(spark):
    rng = random.Random(5)
    rows = [("r", "c" if i % 9 else "rare", f"2026-01-0{1 + i % 3} 0{i % 5}:00:00", None if i % 97 == 0 else int(rng.lognormvariate(5, 2))) for i in range(30000)]
    logs = spark.createDataFrame(rows, "route string, category string, ts string, duration_ms long").withColumn("ts", F.to_timestamp("ts"))
    ranked = ER.percentile_ranks(logs, ER.latency_percentiles(ER.latency_sketches(logs))).collect()
    assert {r["level"] for r in ranked} == set(ER.LEVELS) and sum(r["n"] for r in ranked if r["level"] == "all") == sum(r[3] is not None for r in rows)
    for r in ranked:
        for p, lo, hi in zip(ER.PERCENTILES, r["below"], r["upto"]):
            assert lo - ER.RANK_ERROR <= p <= hi + ER.RANK_ERROR
    assert any(r["n"] > ER.SKETCH_K for r in ranked) and ER.latency_percentiles(ER.latency_sketches(logs.limit(0))).count() == 0


def test_first_items_equal_a_plain_search():
    rng = random.Random(2)
    for _ in range(300):
        items = ["".join(rng.choice("ab ") for _ in range(rng.randrange(0, 9))) if rng.random() < 0.9 else None for _ in range(8)]
        labels = [["".join(rng.choice("ab ") for _ in range(rng.randrange(0, 5))) if rng.random() < 0.9 else None for _ in range(4)] for _ in range(3)]
        want = []
        for no, variants in enumerate(labels):
            for v, text in enumerate(variants):
                hit = next((i for i, x in enumerate(items) if text and len(text) >= 2 and x and text in x), None)
                if hit is not None:
                    want.append((no, v, hit))
                    break
        assert EV.first_items(items, labels) == want


def test_boxes_of_odd_documents(spark):
    item = "struct<str:string,width:double,height:double,transform:array<double>>"
    rows = [("d", [("Total 12.00", 60.0, 1.0, [10.0, 0.0, 0.0, 10.0, 40.0, 700.0]), (None, 1.0, 1.0, [1.0] * 6), ("TOTAL", 1.0, 1.0, [1.0, 0.0, 0.0, 1.0, -50.0, 900.0])],
             [(7, "Total", [" total ", "x"]), (8, "Currency", ["1", None])]), ("n", None, None), ("e", [], [(7, "Total", ["total"])])]
    df = spark.createDataFrame(rows, f"doc_id string, items array<{item}>, labels array<struct<label_no:int,label:string,vs:array<string>>>")
    page = "named_struct('width', 600D, 'height', 800D, 'scale', 1D, 'transform', array(1D, 0D, 0D, -1D, 0D, 800D)) AS page"
    got = [tuple(r) for r in EV.evidence_boxes(df.selectExpr("*", page)).collect()]
    assert got == [("d", 7, "Total", 0, 0, 40 / 600, 90 / 800, 60 / 600, 10 / 800)]
