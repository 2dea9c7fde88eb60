"""Replayed streams: a part is written by many tasks, one micro-batch each, and decided as the batch query decides."""

from pyspark.sql import functions as F

from ledgerlens.plans.replays import replay


def test_a_part_is_written_by_many_tasks_and_taken_as_one_batch(spark):
    rows = spark.range(0, 4000, numPartitions=4)
    seen = replay([rows.where("id % 2 = 1"), rows.where("id % 2 = 0")], lambda s: s.select(
        "id", F.col("_metadata.file_path").alias("f"), F.current_timestamp().alias("batch")))
    got = seen.selectExpr("id", "f", "id % 2 AS odd", "batch").groupBy("odd").agg(
        F.count("*").alias("n"), F.count_distinct("f").alias("files"), F.count_distinct("batch").alias("batches"), F.min("batch").alias("at"))
    odd, even = got.orderBy(F.desc("odd")).collect()
    assert (odd.n, even.n) == (2000, 2000)
    assert odd.files > 1 and even.files > 1
    assert (odd.batches, even.batches) == (1, 1) and odd.at < even.at


def test_rows_of_a_key_stay_in_time_order(spark):
    from ledgerlens.streaming.gates import stream_admission
    rows = spark.range(0, 300, numPartitions=4).selectExpr("299 - id AS event_id", "CAST(id % 3 AS STRING) AS key", "(299 - id) * 1000000 AS ts_us")
    out = replay([rows], lambda s: stream_admission(s, 5, 60_000_000), "key").where("ok")
    assert [r.n for r in out.groupBy("key").agg(F.count("*").alias("n")).collect()] == [25, 25, 25]
