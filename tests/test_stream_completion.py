"""R2 as a stream: replay equals the batch query, after a restart and with a repeated batch; R1's places survive restarts in linear time."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from ledgerlens.operators import chunks as CH
from ledgerlens.operators import folds
from ledgerlens.plans import streams as P
from ledgerlens.sources.invoices import AS_OF
from ledgerlens.streaming.chunks import stream_field_events, stream_gated_outcomes, stream_outcomes

SCHEMA = "response_id string, seq long, chunk string, last boolean"
OUT = ["response_id", "type", "code", "message", "n_flags"]


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def source(spark, path, schema=SCHEMA, **options):
    r = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    for k, v in options.items():
        r = r.option(k, v)
    return r.parquet(path)


def run(df, d, sink="out"):
    q = (df.writeStream.format("parquet").option("path", os.path.join(d, sink)).option("checkpointLocation", os.path.join(d, "ck-" + sink))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(600)
    q.stop()
    assert q.exception() is None


def parts(spark, sf):
    """Some responses of every kind of text, in chunks, with their calls."""
    src = P.broken_responses(spark, sf).where("order_key % 960 < 32").cache()
    chunks = CH.chunk_rows(src.selectExpr("doc_id AS response_id", "value AS text", "CAST(150 + order_key % 41 AS INT) AS size"))
    last = chunks.groupBy("response_id").agg(F.max("seq").alias("n"))
    chunks = chunks.join(last, "response_id").selectExpr("response_id", "seq", "chunk", "seq = n AS last").cache()
    calls = src.selectExpr("doc_id AS response_id", "(order_key % 90) / 75D AS cost", "CASE WHEN order_key % 3 = 0 THEN 0.5D END AS cap")
    return src, chunks, calls


def test_replay_equals_batch_after_restart_and_repeats(spark, sf_small):
    src, chunks, calls = parts(spark, sf_small)
    assert src.selectExpr("order_key % 16 AS k").distinct().count() == 16
    d = folder()
    late = chunks.where("seq % 5 = 3")                                  # arrive before those that precede them
    late.coalesce(1).write.parquet(os.path.join(d, "in", "p0"))
    make = lambda: stream_outcomes(source(spark, os.path.join(d, "in"), maxFilesPerTrigger=1), calls, AS_OF).selectExpr(
        "response_id", "type", "code", "message", "CASE WHEN type = 'complete' THEN size(record.flags) END AS n_flags")
    run(make(), d)
    assert spark.read.parquet(os.path.join(d, "out")).count() == 0
    chunks.where("seq % 5 < 3").coalesce(1).write.parquet(os.path.join(d, "in", "p1"))
    run(make(), d)                                                      # a new query from the same checkpoint
    chunks.where("seq % 5 >= 2").coalesce(1).write.parquet(os.path.join(d, "in", "p2"))     # with repeats
    late.coalesce(1).write.parquet(os.path.join(d, "in", "p3"))         # a whole batch again
    run(make(), d)
    got = spark.read.parquet(os.path.join(d, "out")).select(*OUT)
    want = P.q_response_completion(spark, sf_small).join(src.selectExpr("doc_id AS response_id"), "response_id").select(*OUT)
    assert got.count() == want.count() == src.count()
    assert got.exceptAll(want).count() == 0
    kinds = {(r["type"], r["code"]) for r in got.select("type", "code").distinct().collect()}
    assert kinds == {("complete", None), ("error", CH.BAD_CODE), ("error", CH.CAP_CODE)}


def test_idle_responses_end_once(spark):
    d = folder()
    calls = spark.createDataFrame([("a", 0.1, None)], "response_id string, cost double, cap double")
    for part, rows in enumerate([[("a", 0, "{", False)], [("b", 0, "x", True)], [("c", 0, "[1]", True)], [("a", 1, "}", True)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(d, "in", f"p{part}"))
        run(stream_outcomes(source(spark, os.path.join(d, "in")), calls, AS_OF, idle_timeout_ms=300_000 if part != 2 else 1)
            .select("response_id", "type", "code", "message"), d)
        time.sleep(0.2)
    got = sorted(tuple(r) for r in spark.read.parquet(os.path.join(d, "out")).collect())
    assert ("b", "error", CH.BAD_CODE, CH.BAD_JSON) in got and ("c", "error", CH.BAD_CODE, CH.BAD_SCHEMA) in got
    assert [r[0] for r in got] == ["a", "b", "c"]


def test_timed_out_response(spark):
    d = folder()
    calls = spark.createDataFrame([], "response_id string, cost double, cap double")
    make = lambda: stream_outcomes(source(spark, os.path.join(d, "in")), calls, AS_OF, idle_timeout_ms=1).select(
        "response_id", "type", "code", "message")
    for part, rows in enumerate([[("a", 0, "{", False)], [("z", 1, "x", False)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(d, "in", f"p{part}"))
        run(make(), d)
        time.sleep(0.2)
    got = [tuple(r) for r in spark.read.parquet(os.path.join(d, "out")).where("response_id = 'a'").collect()]
    assert got == [("a", "error", CH.TIMEOUT_CODE, CH.TIMEOUT_MESSAGE)]


def test_gate_behind_completion_equals_batch_fold(spark, sf_small):
    src, chunks, _ = parts(spark, sf_small)
    calls = src.selectExpr("doc_id AS response_id", "CAST(order_key % 2 AS STRING) AS key",
                           "CASE WHEN order_key % 7 = 0 THEN NULL WHEN order_key % 5 = 0 THEN 0.4D ELSE 0.01D + (order_key % 13) / 1000D END AS cost")
    d = folder()
    chunks.coalesce(1).write.parquet(os.path.join(d, "in", "p0"))
    run(stream_gated_outcomes(source(spark, os.path.join(d, "in")), calls, AS_OF).select("response_id", "type", "code", "cost"), d)
    got = {r["response_id"]: (r["type"], r["code"]) for r in spark.read.parquet(os.path.join(d, "out")).collect()}
    usable = {r["doc_id"] for r in P.q_record_source(spark, sf_small).select("doc_id", "error").collect() if r["error"] is None}
    good = spark.createDataFrame([(x,) for x in sorted(usable)], "response_id string")
    fold = folds.median_cost_cap(calls.join(good, "response_id").where("cost IS NOT NULL"), ["key"], "cost", ["response_id"])
    over = {r["response_id"] for r in fold.where("exceeded").collect()}
    assert over and len(got) == src.count()
    for rid, end in got.items():
        assert end == (("error", CH.CAP_CODE) if rid in over else ("complete", None) if rid in usable else ("error", CH.BAD_CODE))


def test_places_survive_restarts_in_linear_time(spark, sf_small):
    text = max((r["text"] for r in P.responses(spark, sf_small).limit(200).collect()), key=len)
    text = text[:text.index('"flags":[')] + '"flags":[{"severity":"info","message":"' + "é\\\"]}" * 3000 + '"}]}'

    def feed(pieces):
        events, looked, parts, parser = [], 0, [], CH.FieldParser()
        for piece in pieces:
            events += parser.feed(piece)
            parts.append(parser.forget())
            looked += parser.looked_at
            new = CH.FieldParser(lambda: "".join(parts))
            for name in ("buffer", "base", "emitted", "scans", "_located", "_searched"):
                setattr(new, name, getattr(parser, name))
            parser = new
        return events, looked
    cut = lambda n: [text[i:i + n] for i in range(0, len(text), n)]
    many, few, one = feed(cut(-(-len(text) // 1000))), feed(cut(-(-len(text) // 10))), CH.FieldParser()
    assert sorted(many[0]) == sorted(few[0]) == sorted(one.feed(text)) and len(many[0]) == len(CH.STREAM_KEYS)
    assert many[1] <= 2 * few[1]


def test_field_events_in_many_batches(spark, sf_small):
    d = folder()
    some = [r["response_id"] for r in P.responses(spark, sf_small).limit(6).collect()]
    chunks = P.response_chunks(spark, sf_small).where(F.col("response_id").isin(some)).cache()
    for k in range(4):
        chunks.where(f"seq % 4 = {3 - k}").coalesce(1).write.parquet(os.path.join(d, "in", f"p{k}"))
    run(stream_field_events(source(spark, os.path.join(d, "in"), "response_id string, seq long, chunk string", maxFilesPerTrigger=1)), d)
    got = spark.read.parquet(os.path.join(d, "out")).where("field NOT IN ('complete', 'error')")
    want = CH.field_events(chunks)
    assert got.count() == want.count() == 6 * len(CH.STREAM_KEYS) and got.exceptAll(want).count() == 0
