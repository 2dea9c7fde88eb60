import datetime as dt
import os
import tempfile

from ledgerlens.operators import admission as A
from ledgerlens.operators import folds
from ledgerlens.streaming import gates, validation


def _run(q, name, spark):
    q.awaitTermination(300)
    q.stop()
    return spark.sql(f"SELECT * FROM {name}")


def test_stream_admission_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    base = dt.datetime(2024, 1, 1)
    rows = [(i, f"k{i % 3}", base + dt.timedelta(minutes=7 * i)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, key string, ts timestamp").selectExpr(
        "*", "unix_micros(ts) AS ts_us")
    df.coalesce(1).write.parquet(os.path.join(d, "in"))
    src = spark.readStream.schema(df.schema).parquet(os.path.join(d, "in"))
    q = (gates.stream_admission(src, limit=3, window_us=3_600_000_000).writeStream.format("memory")
         .queryName("adm_test").outputMode("append").option("checkpointLocation", os.path.join(d, "ck"))
         .trigger(availableNow=True).start())
    got = _run(q, "adm_test", spark).select("event_id", "ok", "remaining", "retry_after_s")
    exp = A.admit(df, key="key", limit=3, window_us=3_600_000_000).select("event_id", "ok", "remaining",
                                                                          "retry_after_s")
    assert got.count() == 120 and got.exceptAll(exp).count() == 0


def test_stream_median_cap_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = [(i, f"u{i % 2}", i, [0.01, 0.02, 0.5, 0.02, 1.2, 0.03][i % 6]) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, key string, ts_us long, cost double")
    df.coalesce(1).write.parquet(os.path.join(d, "in"))
    src = spark.readStream.schema(df.schema).parquet(os.path.join(d, "in"))
    q = (gates.stream_median_cap(src).writeStream.format("memory").queryName("med_test").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    got = _run(q, "med_test", spark).select("event_id", "exceeded", "cap", "median")
    exp = folds.median_cost_cap(df, ["key"], "cost", ["ts_us", "event_id"]).select(
        "event_id", "exceeded", "cap", "median")
    assert got.count() == 60 and got.exceptAll(exp).count() == 0


def test_monthly_gate_across_batches(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    base = dt.datetime(2024, 1, 1)
    for part in range(3):
        rows = [(part * 10 + i, base + dt.timedelta(hours=part * 10 + i), 1.0) for i in range(10)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, cost double").coalesce(1).write.parquet(
            os.path.join(d, "in", f"p{part}"))
    src = (spark.readStream.schema("event_id long, ts timestamp, cost double").option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", True).parquet(os.path.join(d, "in")))
    q = (src.writeStream.foreachBatch(gates.monthly_gate_batch(os.path.join(d, "state"), os.path.join(d, "out"),
                                                               budget=25.0))
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    q.stop()
    got = {r["event_id"]: r["refused"] for r in spark.read.parquet(os.path.join(d, "out")).collect()}
    assert [got[i] for i in range(30)] == [i >= 25 for i in range(30)]


def test_validation_stream(spark):
    from ledgerlens.operators.chunks import record_json_sql
    from tests.util import record, records_df
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    good = records_df(spark, [record(), record(total=200.0)]).selectExpr(f"{record_json_sql()} AS value")
    good.unionByName(spark.createDataFrame([("{oops",)], "value string")).coalesce(1).write.text(
        os.path.join(d, "in"))
    raw = spark.readStream.text(os.path.join(d, "in"))
    q1, q2 = validation.start(raw, "2026-06-01", os.path.join(d, "good"), os.path.join(d, "dead"),
                              os.path.join(d, "ck"))
    q1.awaitTermination(300)
    q2.awaitTermination(300)
    g = spark.read.parquet(os.path.join(d, "good"))
    assert g.count() == 2 and spark.read.parquet(os.path.join(d, "dead")).count() == 1
    assert sorted(r[0] for r in g.selectExpr("size(record.flags)").collect()) == [0, 1]


def test_late_requests_are_decided(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    schema = "event_id long, key string, ts_us long"
    for part, rows in enumerate([[(1, "k", 10**12)], [(2, "k", 10**12 + 10**11)], [(3, "k", 5), (4, "z", 7)], [(5, "k", 10**12 + 10**11 + 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(d, "in", f"p{part}"))
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(os.path.join(d, "in")))
    q = (gates.stream_admission(src, limit=3, window_us=3_600_000_000).writeStream.format("memory").queryName("late_test")
         .outputMode("append").option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    assert sorted(r["event_id"] for r in _run(q, "late_test", spark).collect()) == [1, 2, 3, 4, 5]


def test_repeated_batch_changes_nothing(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    handler = gates.monthly_gate_batch(os.path.join(d, "state"), os.path.join(d, "out"), budget=3.0)
    batch = [spark.createDataFrame([(i * 10 + j, dt.datetime(2024, 1, 1, i, j), 1.0) for j in range(2)], "event_id long, ts timestamp, cost double")
             for i in range(3)]
    for i, b in ((0, 0), (0, 0), (5, 1), (5, 1), (9, 2)):           # batch ids with gaps, each run twice
        handler(batch[b], i)
    got = {r["event_id"]: r["refused"] for r in spark.read.parquet(os.path.join(d, "out")).collect()}
    assert spark.read.parquet(os.path.join(d, "out")).count() == 6
    assert got == {0: False, 1: False, 10: False, 11: True, 20: True, 21: True}
