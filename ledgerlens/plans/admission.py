"""M4 - request admission over the events as requests (key = user)."""

from __future__ import annotations

from ledgerlens.operators import admission as A
from ledgerlens.plans.registry import query
from ledgerlens.sources.usage import usage_rows

LIMIT, WINDOW_US = 3, A.DAY_US      # 3 per 24 h: the app's 20 per hour never trips here
W = WINDOW_US


@query("rate_admission", f"""
WITH RECURSIVE ev AS (
  SELECT user_id, event_id, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
r AS (
  SELECT user_id, rn, event_id, t, true AS ok, CAST({LIMIT - 1} AS BIGINT) AS remaining,
         CAST(0 AS BIGINT) AS retry_after_s, t + {W} AS reset_at_us, [t] AS hist FROM ev WHERE rn = 1
  UNION ALL
  SELECT user_id, rn, event_id, t, ok,
         CASE WHEN ok THEN greatest(0, {LIMIT} - len(rec) - 1) ELSE 0 END,
         CASE WHEN ok THEN 0 ELSE CAST(ceil(greatest(0, rec[1] + {W} - t) / 1e6) AS BIGINT) END,
         CASE WHEN ok THEN t + {W} ELSE rec[1] + {W} END,
         CASE WHEN ok THEN list_append(rec, t) ELSE rec END
  FROM (SELECT *, len(rec) < {LIMIT} AS ok
        FROM (SELECT e.user_id, e.rn, e.event_id, e.t, list_filter(r.hist, lambda x: x > e.t - {W}) AS rec
              FROM r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1) a) b)
SELECT event_id, user_id, ok, CAST(remaining AS BIGINT) AS remaining, CAST(retry_after_s AS BIGINT) AS retry_after_s,
       CAST(reset_at_us AS BIGINT) AS reset_at_us FROM r""")
def q_rate_admission(spark, sf_dir):
    from ledgerlens.operators.folds import segmented_admission
    req = usage_rows(spark, sf_dir).select("event_id", "user_id", "ts_us")
    out = segmented_admission(req, "user_id", "ts_us", ["event_id"], LIMIT, WINDOW_US)
    return out.select("event_id", "user_id", "ok", "remaining", "retry_after_s", "reset_at_us")


@query("sliding_request_count", f"""
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
       RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS n_in_window FROM events""")
def q_sliding_request_count(spark, sf_dir):
    req = usage_rows(spark, sf_dir).select("event_id", "user_id", "ts_us")
    return A.sliding_count(req, key="user_id", window_us=WINDOW_US).select(
        "event_id", "user_id", "n_in_window")
