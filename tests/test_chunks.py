import json
import os
import tempfile

from ledgerlens.operators import chunks as CH
from ledgerlens.operators.chunks import FieldParser


def test_emits_on_close_once():
    p = FieldParser()
    assert p.feed('{"invoice_number":{"value":"INV') == []
    out = p.feed('-1","confidence":"high","reasoning":"x"},')
    assert out == [("invoice_number", '{"value":"INV-1","confidence":"high","reasoning":"x"}')]
    assert p.feed('"tax":{"value":1}') == [("tax", '{"value":1}')]
    assert p.feed("") == []


def test_escaped_quotes_and_braces_in_strings():
    p = FieldParser()
    out = p.feed('{"vendor":{"name":"A \\"}\\" B","address":null}')
    assert out and json.loads(out[0][1])["name"] == 'A "}" B'


def test_arrays_and_several_fields_in_key_order():
    p = FieldParser()
    text = '{"flags":[{"severity":"info","message":"m"}],"line_items":[],"currency":{"value":"USD"}}'
    out = p.feed(text)
    assert [k for k, _ in out] == ["currency", "line_items", "flags"]


def test_primitive_not_emitted():
    p = FieldParser()
    assert p.feed('{"invoice_number":"INV-1","tax":null}') == []


def test_batch_equals_stream(spark, sf_small):
    from ledgerlens.plans.streams import response_chunks
    from ledgerlens.streaming.chunks import stream_field_events
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    ch = response_chunks(spark, sf_small).filter("response_id < 'INV-3'")
    ch.write.parquet(os.path.join(d, "chunks"))
    src = spark.readStream.schema(ch.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "chunks"))
    q = (stream_field_events(src).writeStream.format("memory").queryName("fe_test").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    q.stop()
    got = spark.sql("SELECT response_id, field, seq, value_json FROM fe_test")
    n = ch.select("response_id").distinct().count()
    assert got.where("field = 'complete'").count() == n
    got = got.where("field <> 'complete'")
    exp = CH.field_events(ch).select("response_id", "field", "seq", "value_json")
    assert got.count() == exp.count() > 0
    assert got.exceptAll(exp).count() == 0


def test_completion_split(spark):
    good = '{"invoice_number":{"value":"1","confidence":"high","reasoning":"r"}}'
    rows = [("a", 0, good[:10]), ("a", 1, good[10:]), ("b", 0, "{oops")]
    df = spark.createDataFrame(rows, "response_id string, seq long, chunk string")
    got = {r["response_id"]: r["error"] for r in CH.completed(df).collect()}
    assert got == {"a": "missing-key", "b": "invalid-json"}


def test_whole_text_equals_parser(spark, sf_small):
    """Each whole response's events are those of the incremental parser fed chunk by chunk."""
    from ledgerlens.plans.streams import response_chunks
    ch = response_chunks(spark, sf_small).filter("response_id < 'INV-12'")
    got = sorted(tuple(r) for r in CH.field_events(ch).collect())
    want, parsers = [], {}
    for r in sorted(ch.collect()):
        for key, text in parsers.setdefault(r["response_id"], FieldParser()).feed(r["chunk"] or ""):
            want.append((r["response_id"], key, CH.STREAM_KEYS.index(key), r["seq"], len(text), text))
    assert got == sorted(want) and got


def _stream(spark, rows, idle=600_000, wait=0):
    """Feeds lists of chunks as micro-batches, then waits."""
    import time

    from ledgerlens.streaming.chunks import stream_field_events
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    name = "s" + os.path.basename(d).replace("-", "_")
    schema = "response_id string, seq long, chunk string"
    os.makedirs(os.path.join(d, "in"))
    src = spark.readStream.schema(schema).json(os.path.join(d, "in"))
    q = (stream_field_events(src, idle).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ck")).start())
    for i, part in enumerate(rows):
        with open(os.path.join(d, f"p{i}"), "w") as f:
            f.writelines(json.dumps(dict(zip(("response_id", "seq", "chunk"), r))) + "\n" for r in part)
        os.rename(os.path.join(d, f"p{i}"), os.path.join(d, "in", f"p{i}"))
        q.processAllAvailable()
        time.sleep(wait)
    q.stop()
    return [tuple(r)[:4] for r in spark.sql(f"SELECT * FROM {name}").collect()]


def test_stream_ends_once_and_ignores_what_follows(spark):
    text = "{" + ",".join(f'"{k}":{{}}' for k in CH.STREAM_KEYS) + "}"
    got = _stream(spark, [[("a", 1, text[40:])], [("a", 0, text[:40])], [("a", 0, text[:40]), ("a", 2, "x")]])
    assert [g[1] for g in got] == [*CH.STREAM_KEYS, "complete"]


def test_idle_response_ends_in_an_error(spark):
    got = _stream(spark, [[("a", 0, '{"tax":{}'), ("c", 0, "")], [("b", 0, "{")], [("b", 1, " ")], [("b", 2, " ")]], 1000, 1.5)
    assert ("a", "tax", 6, 0) in got and ("a", "error", -1, 1) in got and ("c", "error", -1, 1) in got
