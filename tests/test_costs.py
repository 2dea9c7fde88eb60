import math
import random

import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.operators import costs as C
from ledgerlens.operators import folds
from ledgerlens.operators.prefix import running_sum


def usage(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, model string, "
                                       "input_tokens long, output_tokens long")


def test_cost_prefix_and_unknown(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    u = usage(spark, [(1, 1, t, "claude-sonnet-4-6", 1_000_000, 1_000_000),
                      (2, 1, t, "claude-sonnet-4-6-20250514", 1000, 100),
                      (3, 1, t, "nope", 10, 10), (4, 1, t, "claude-haiku-4-5", 0, 0)])
    p = C.resolve_pricing(C.builtin_pricing(spark), C.parse_pricing_overrides(spark, None)[0])
    got = {r["event_id"]: r["cost"] for r in C.call_costs(u, p).collect()}
    assert got[1] == 18.0 and math.isclose(got[2], 0.003 + 0.0015) and got[3] is None and got[4] == 0.0


def test_overrides(spark):
    ov, reason = C.parse_pricing_overrides(
        spark, '{"claude-sonnet-4-6": {"inputPerMillion": 1, "outputPerMillion": 2}, '
               '"custom-": {"inputPerMillion": 0.5, "outputPerMillion": 0.5}}')
    assert reason is None
    p = {r["prefix"]: r for r in C.resolve_pricing(C.builtin_pricing(spark), ov).collect()}
    assert p["claude-sonnet-4-6"]["input_per_million"] == 1.0 and p["claude-sonnet-4-6"]["ord"] == 0
    assert p["custom-"]["ord"] >= 100 and p["claude-opus-4-7"]["input_per_million"] == 15.0


def test_bad_overrides(spark):
    assert C.parse_pricing_overrides(spark, "{bad")[1] == "non-json"
    assert C.parse_pricing_overrides(spark, "[1, 2]")[1] == "non-object"
    assert C.parse_pricing_overrides(spark, '{"m": {"inputPerMillion": -1, "outputPerMillion": 1}}')[1] \
        == "invalid-entry"
    assert C.parse_pricing_overrides(spark, '{"m": {"inputPerMillion": "3", "outputPerMillion": 1}}')[1] \
        == "invalid-entry"
    ov, reason = C.parse_pricing_overrides(spark, '{"m": {"inputPerMillion": 1}}')
    assert reason == "invalid-entry" and ov.count() == 0


def test_budget_setting_parse(spark):
    df = spark.createDataFrame([("50",), ("\t50\n",), (" 12.5 ",), ("50 USD",), ("0",), ("",), (None,), ("-3",)], "raw string")
    got = [(r["budget"], r["reason"]) for r in df.selectExpr(*C.budget_setting("raw")).collect()]
    assert got == [(50.0, None), (50.0, None), (12.5, None), (25.0, "non-numeric"), (25.0, "non-positive"),
                   (25.0, None), (25.0, None), (25.0, "non-numeric")]


def _brute_median_cap(costs):
    hist, out = [], []
    for c in costs:
        med = folds._median(hist)
        if c > 1.0:
            out.append((True, 1.0, med))
            continue
        cap = None if med in (None, 0) else med * 3
        ex = cap is not None and c > cap
        if not ex and c >= 0:
            hist = (hist + [c])[-50:]
        out.append((ex, cap, med))
    return out


def test_median_cap_fold_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for user in range(3):
        for i in range(130):
            rows.append((user * 1000 + i, user, i, round(rnd.choice([0.01, 0.02, 0.05, 0.2, 1.5, 0.0]) *
                                                          rnd.random(), 4)))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts long, cost double")
    got = folds.median_cost_cap(df, ["user_id"], "cost", ["ts", "event_id"]).toPandas()
    for user in range(3):
        g = got[got.user_id == user].sort_values("ts")
        exp = _brute_median_cap(g["cost"].tolist())
        nn = lambda xs: [None if x is None or (isinstance(x, float) and math.isnan(x)) else x for x in xs]
        assert list(zip(g["exceeded"].tolist(), nn(g["cap"].tolist()), nn(g["median"].tolist()))) == exp


def test_median_odd_even():
    assert folds._median([3.0, 1.0, 2.0]) == 2.0
    assert folds._median([4.0, 1.0, 2.0, 3.0]) == 2.5
    assert folds._median([]) is None


def test_running_sum_matches_pandas(spark):
    rnd = random.Random(3)
    rows = [(i, "2024-01" if i % 3 else "2024-02", rnd.randint(0, 50), float(rnd.randint(0, 100)) / 7)
            for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, month string, t long, v double")
    got = running_sum(df, "v", ["month"], ["t", "id"], "before", num_partitions=7).toPandas()
    pdf = pd.DataFrame(rows, columns=["id", "month", "t", "v"]).sort_values(["month", "t", "id"])
    pdf["exp"] = pdf.groupby("month")["v"].cumsum() - pdf["v"]
    m = got.merge(pdf, on="id")
    assert (abs(m["before"] - m["exp"]) < 1e-6).all()


def test_monthly_gate(spark):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 10.0) for i in range(6)]
    rows += [(100, dt.datetime(2024, 2, 1), 10.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, cost double")
    got = {r["event_id"]: r["refused"] for r in C.monthly_budget_gate(df, 25.0, num_partitions=3).collect()}
    assert [got[i] for i in range(6)] == [False, False, False, True, True, True] and got[100] is False


def test_monthly_spend_ignores_bad(spark):
    import datetime as dt
    t = dt.datetime(2024, 3, 5)
    df = spark.createDataFrame([(1, t, 1.5), (2, t, -1.0), (3, t, None), (4, t, float("nan"))],
                               "event_id long, ts timestamp, cost double")
    r = C.monthly_spend(df).collect()[0]
    assert r["month"] == "2024-03" and r["spend"] == 1.5 and r["calls"] == 4


def test_rolling_median_halo_matches_brute_force(spark):
    from ledgerlens.operators.halo import rolling_median_prev
    rnd = random.Random(11)
    rows = [(i, "hot" if i % 10 < 7 else f"k{i % 5}", i, float(rnd.randint(1, 100))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, key string, t long, v double")
    got = rolling_median_prev(df, "key", ["t", "id"], "v", 50, "m", num_partitions=23).toPandas()
    pdf = pd.DataFrame(rows, columns=["id", "key", "t", "v"]).sort_values(["key", "t", "id"])
    pdf["exp"] = pdf.groupby("key")["v"].transform(lambda s: s.shift(1).rolling(50, min_periods=1).median())
    m = got.merge(pdf, on="id")
    both_null = m["m"].isna() & m["exp"].isna()
    assert (both_null | ((m["m"] - m["exp"]).abs() < 1e-9)).all()


def test_exact_median_matches_pandas(spark):
    from ledgerlens.operators.quantiles import exact_median
    rnd = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 4}", float(rnd.randint(0, 40)) / 4) for i in range(1001)]
    rows += [("odd", 1.0), ("odd", 3.0), ("odd", 2.0), ("even", 1.0), ("even", 4.0), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["median"]) for r in exact_median(df, "g", "v", num_partitions=7).collect()}
    exp = pd.DataFrame(rows, columns=["g", "v"]).dropna().groupby("g")["v"].agg(["count", "median"])
    for g, row in exp.iterrows():
        assert got[g][0] == row["count"] and abs(got[g][1] - row["median"]) < 1e-12, g
    assert "nan" not in got and got["even"][1] == 2.5 and got["odd"][1] == 2.0


def test_long_price_map_is_joined(spark, monkeypatch):
    import datetime as dt
    u = usage(spark, [(i, 1, dt.datetime(2024, 1, 1), m, 1_000_000, 0) for i, m in enumerate(["claude-opus-4-7-x", "m1-a", "m12", "zz", None, ""])])
    pricing = spark.createDataFrame([("claude-opus-4-7", 15.0, 75.0, 0), ("m1", 1.0, 1.0, 1), ("m12", 2.0, 1.0, 2)],
                                    "prefix string, input_per_million double, output_per_million double, ord int")
    want = {0: 15.0, 1: 1.0, 2: 1.0, 3: None, 4: None, 5: None}
    short = C.call_costs(u, pricing)
    assert {r["event_id"]: r["cost"] for r in short.collect()} == want
    assert "Exchange" not in short._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "INLINE_PRICES", 2)
    joined = C.call_costs(u, pricing)
    assert {r["event_id"]: r["cost"] for r in joined.collect()} == want
