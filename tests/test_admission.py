from ledgerlens.operators import admission as A
from pyspark.sql import functions as F

H = 3_600_000_000


def test_sliding_window(spark):
    rows = [(i, "k1", i * 60_000_000) for i in range(5)] + [(10, "k2", 0), (11, "k1", H + 1)]
    df = spark.createDataFrame(rows, "event_id long, key string, ts_us long")
    got = {r["event_id"]: r for r in A.admit(df, limit=3, window_us=H).collect()}
    assert [got[i]["ok"] for i in range(5)] == [True, True, True, False, False]
    assert [got[i]["remaining"] for i in range(3)] == [2, 1, 0]
    assert got[3]["retry_after_s"] == 3600 - 180 and got[4]["retry_after_s"] == 3600 - 240
    assert got[10]["ok"]                           # keys are independent
    assert got[11]["ok"]                           # first admitted time left the window


def test_refused_calls_not_counted(spark):
    # limit 1: call at 0 admitted, 30 min refused, 61 min admitted (the refused one did not count)
    df = spark.createDataFrame([(1, "k", 0), (2, "k", H // 2), (3, "k", H + 60_000_000)],
                               "event_id long, key string, ts_us long")
    got = {r["event_id"]: r["ok"] for r in A.admit(df, limit=1, window_us=H).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_client_key(spark):
    rows = [("203.0.113.5, 10.0.0.1", None, "203.0.113.5"), ("garbage, 198.51.100.2", None, "198.51.100.2"),
            ("<script>", "198.51.100.7", "198.51.100.7"), ("", "not-an-ip", "unknown"),
            (None, None, "unknown"), ("2001:db8::1", None, "2001:db8::1"), (" 192.0.2.1 ", None, "192.0.2.1"),
            ("999.1.1.1", None, "unknown")]
    df = spark.createDataFrame([r[:2] for r in rows], "x_forwarded_for string, x_real_ip string")
    got = [r[0] for r in df.select(F.expr(A.client_key_sql())).collect()]
    assert got == [r[2] for r in rows]


def test_retry_class(spark):
    df = spark.createDataFrame([(429, "x", "Error"), (503, "x", "Error"), (400, "x", "Error"),
                                (None, "fetch failed", "Error"), (None, "Request TIMEOUT", "Error"),
                                (None, "aborted network", "AbortError"), (None, "bad", "Error")],
                               "status int, message string, error_name string")
    got = [r[0] for r in df.select(F.expr(A.retry_class_sql())).collect()]
    assert got == [True, True, False, True, True, False, False]


def test_sliding_count_matches_window(spark):
    import random
    rnd = random.Random(5)
    rows = [(i, "hot" if i % 4 else f"k{i % 3}", rnd.randint(0, 50) * 1_000_000) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, key string, ts_us long")
    a = A.sliding_count(df, window_us=10_000_000, num_partitions=9).select("event_id", "n_in_window")
    b = df.withColumn("n_in_window", F.expr(
        "count(*) OVER (PARTITION BY key ORDER BY ts_us RANGE BETWEEN 9999999 PRECEDING AND CURRENT ROW)")).select("event_id", "n_in_window")
    assert a.count() == 600 and a.exceptAll(b).count() == 0


def test_segmented_admission_equals_fold(spark):
    import random
    from ledgerlens.operators.folds import segmented_admission
    rnd = random.Random(9)
    t, rows = 0, []
    for i in range(800):
        t += rnd.choice([1, 5, 20, 90, 200]) * 60_000_000            # minutes apart, some > 1 h gaps
        rows.append((i, "hot" if i % 5 else "k", t))
    df = spark.createDataFrame(rows, "event_id long, key string, ts_us long")
    a = segmented_admission(df, "key", "ts_us", ["event_id"], 3, H, num_partitions=11)
    b = A.admit(df, limit=3, window_us=H)
    cols = ["event_id", "ok", "remaining", "retry_after_s", "reset_at_us"]
    assert a.count() == 800 and a.select(cols).exceptAll(b.select(cols)).count() == 0


def test_sliding_count_with_repeated_ids(spark):
    rows = [("a", 1, 7), ("a", 1, 7), ("b", 1, 7), ("a", 5, 8), ("b", 100, 8)]
    df = spark.createDataFrame(rows, "key string, ts_us long, event_id long")
    got = sorted((r["key"], r["ts_us"], r["n_in_window"]) for r in A.sliding_count(df, window_us=10, num_partitions=3).collect())
    assert got == [("a", 1, 2), ("a", 1, 2), ("a", 5, 3), ("b", 1, 1), ("b", 100, 1)]


def test_client_key_trims_any_white_space(spark):
    df = spark.createDataFrame([("\t203.0.113.9\n, 10.0.0.1", None), (None, "\t2001:db8::1 ")], "x_forwarded_for string, x_real_ip string")
    assert [r[0] for r in df.selectExpr(f"{A.client_key_sql()} AS k").collect()] == ["203.0.113.9", "2001:db8::1"]
