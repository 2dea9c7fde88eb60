"""M4 - pricing, spend, budget gates over the usage rows derived from
``events``."""

from __future__ import annotations

from ledgerlens.functions.sql import lit
from ledgerlens.operators import costs as C
from ledgerlens.operators import folds
from ledgerlens.plans.registry import query
from ledgerlens.sources.usage import HAIKU, MODEL_SQL, OPUS, SONNET, usage_rows

BUDGET = C.MONTHLY_BUDGET_DEFAULT


def priced_usage(spark, sf_dir):
    # no override text here: the price map is the built-ins
    pricing = C.resolve_pricing(C.builtin_pricing(spark), C.parse_pricing_overrides(spark, None)[0])
    return C.call_costs(usage_rows(spark, sf_dir), pricing)


USAGE_CTES = f"""
usage AS (
  SELECT event_id, user_id, ts, epoch_us(ts) AS ts_us, event_type, {MODEL_SQL} AS model,
         CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens
  FROM events),
pricing AS (SELECT * FROM (VALUES ('{SONNET}', 3.0::DOUBLE, 15.0::DOUBLE, 0), ('{OPUS}', 15.0::DOUBLE, 75.0::DOUBLE, 1),
                                  ('{HAIKU}', 1.0::DOUBLE, 5.0::DOUBLE, 2)) t(prefix, pin, pout, ord)),
mp AS (SELECT model, arg_min(pin, ord) AS pin, arg_min(pout, ord) AS pout
       FROM (SELECT DISTINCT model FROM usage) m JOIN pricing p ON starts_with(m.model, p.prefix) GROUP BY model),
costs AS (SELECT u.*, CAST(u.input_tokens AS DOUBLE) / 1e6 * mp.pin + CAST(u.output_tokens AS DOUBLE) / 1e6 * mp.pout AS cost
          FROM usage u LEFT JOIN mp ON mp.model = u.model)"""


def with_usage(sql: str, recursive: bool = False) -> str:
    body = sql.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + USAGE_CTES + ("\n" + body if body.upper().startswith("SELECT") else body)


@query("call_cost", with_usage("""
SELECT event_id, user_id, model, input_tokens, output_tokens, cost FROM costs"""))
def q_call_cost(spark, sf_dir):
    return priced_usage(spark, sf_dir).select("event_id", "user_id", "model", "input_tokens",
                                              "output_tokens", "cost")


@query("monthly_spend", with_usage("""
SELECT strftime(ts, '%Y-%m') AS month, count(*) AS calls, count(cost) AS priced_calls,
       round(coalesce(sum(CASE WHEN cost >= 0 THEN cost END), 0.0), 6) AS spend
FROM costs GROUP BY 1"""))
def q_monthly_spend(spark, sf_dir):
    return C.monthly_spend(priced_usage(spark, sf_dir))


@query("monthly_budget_gate", with_usage(f""",
g AS (SELECT event_id, strftime(ts, '%Y-%m') AS month,
        coalesce(sum(CASE WHEN cost >= 0 THEN cost ELSE 0.0 END) OVER (PARTITION BY strftime(ts, '%Y-%m')
          ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS sb FROM costs)
SELECT event_id, month, round(sb, 6) AS spend_before, round(sb, 9) >= {BUDGET} AS refused FROM g"""))
def q_monthly_budget_gate(spark, sf_dir):
    g = C.monthly_budget_gate(priced_usage(spark, sf_dir), BUDGET)
    return g.selectExpr("event_id", "month", "round(spend_before, 6) AS spend_before", "refused")


def _median(h: str) -> str:
    s = f"list_sort({h})"
    n = f"len({h})"
    return (f"CASE WHEN {n} = 0 THEN NULL WHEN {n} % 2 = 0 THEN ({s}[{n} // 2] + {s}[{n} // 2 + 1]) / 2 "
            f"ELSE {s}[{n} // 2 + 1] END")


@query("median_cost_cap", with_usage(f""",
pc AS (SELECT user_id, event_id, cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
       FROM costs WHERE cost IS NOT NULL),
r AS (
  SELECT user_id, rn, event_id, cost, exceeded, cap, med,
         CASE WHEN NOT exceeded AND cost >= 0 THEN [cost] ELSE CAST([] AS DOUBLE[]) END AS hist
  FROM (SELECT *, cost > 1.0 AS exceeded, CASE WHEN cost > 1.0 THEN 1.0::DOUBLE END AS cap,
               CAST(NULL AS DOUBLE) AS med FROM pc WHERE rn = 1) f
  UNION ALL
  SELECT user_id, rn, event_id, cost, exceeded, cap, med,
         CASE WHEN NOT exceeded AND cost >= 0 THEN list_append(hist, cost)[-50:] ELSE hist END
  FROM (SELECT *, cost > 1.0 OR (med IS NOT NULL AND med <> 0 AND cost > med * 3.0) AS exceeded,
               CASE WHEN cost > 1.0 THEN 1.0::DOUBLE WHEN med IS NULL OR med = 0 THEN NULL ELSE med * 3.0 END AS cap
        FROM (SELECT pc.user_id, pc.rn, pc.event_id, pc.cost, r.hist, {_median('r.hist')} AS med
              FROM r JOIN pc ON pc.user_id = r.user_id AND pc.rn = r.rn + 1) x) y)
SELECT event_id, user_id, cost, exceeded, cap, med AS median FROM r""", recursive=True))
def q_median_cost_cap(spark, sf_dir):
    priced = priced_usage(spark, sf_dir).filter("cost IS NOT NULL")
    w = folds.median_cost_cap(priced.select("event_id", "user_id", "ts", "cost"), ["user_id"], "cost",
                              ["ts", "event_id"])
    return w.select("event_id", "user_id", "cost", "exceeded", "cap", "median")


@query("rolling_median", with_usage("""
SELECT event_id, user_id, round(quantile_cont(cost, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), 9) AS median_prev50
FROM costs WHERE cost IS NOT NULL"""))
def q_rolling_median(spark, sf_dir):
    """Median of the previous 50 priced calls of the user (no
    feedback). Range partitions + a bounded halo (``operators.halo``), so a
    hot user is split across tasks; equal to ``percentile(cost, 0.5) OVER
    (PARTITION BY user ORDER BY ts, id ROWS BETWEEN 50 PRECEDING AND 1
    PRECEDING)``."""
    from ledgerlens.operators.halo import rolling_median_prev
    priced = priced_usage(spark, sf_dir).filter("cost IS NOT NULL").select("event_id", "user_id", "ts", "cost")
    return rolling_median_prev(priced, "user_id", ["ts", "event_id"], "cost", 50, "m").selectExpr(
        "event_id", "user_id", "round(m, 9) AS median_prev50")


@query("budget_settings", """
SELECT user_id, raw,
  CASE WHEN raw IS NULL OR raw = '' THEN 25.0::DOUBLE
       WHEN NOT regexp_matches(cut, '^\\d+(\\.\\d+)?$') THEN 25.0::DOUBLE
       WHEN TRY_CAST(cut AS DOUBLE) <= 0 THEN 25.0::DOUBLE ELSE TRY_CAST(cut AS DOUBLE) END AS budget,
  CASE WHEN raw IS NULL OR raw = '' THEN NULL
       WHEN NOT regexp_matches(cut, '^\\d+(\\.\\d+)?$') THEN 'non-numeric'
       WHEN TRY_CAST(cut AS DOUBLE) <= 0 THEN 'non-positive' END AS reason
FROM (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS cut FROM (SELECT DISTINCT user_id, CASE user_id % 7 WHEN 0 THEN '50' WHEN 1 THEN ' 12.5 ' WHEN 2 THEN '50 USD'
        WHEN 3 THEN '0' WHEN 4 THEN '' WHEN 5 THEN chr(9) || '50' || chr(10) ELSE '-3' END AS raw FROM events) u) t""")
def q_budget_settings(spark, sf_dir):
    """P20 over a per-tenant settings table (one raw setting per user)."""
    from ledgerlens.sources.tables import read_table
    t = read_table(spark, sf_dir, "events", "user_id").distinct().selectExpr(
        "user_id", "CASE user_id % 7 WHEN 0 THEN '50' WHEN 1 THEN ' 12.5 ' WHEN 2 THEN '50 USD' "
        "WHEN 3 THEN '0' WHEN 4 THEN '' WHEN 5 THEN char(9) || '50' || char(10) ELSE '-3' END AS raw")
    return t.selectExpr("user_id", "raw", *C.budget_setting("raw"))


_OVERRIDES = (   # a text per setting, and what it is worth: (reason, prefix, input, output) of its entries
    ("", None, []), ("{bad", "non-json", []), ("[1, 2]", "non-object", []), ("null", "non-object", []),
    ('{"m": {"inputPerMillion": -1, "outputPerMillion": 1}}', "invalid-entry", []),
    ('{"m": {"inputPerMillion": "3", "outputPerMillion": 1}}', "invalid-entry", []),
    ('{"m": {"inputPerMillion": 1}}', "invalid-entry", []),
    ('{"a": {"inputPerMillion": 1, "outputPerMillion": 1}, "b": 3}', "invalid-entry", []),
    ('{"' + SONNET + '": {"inputPerMillion": 1, "outputPerMillion": 2.5}, "legacy": {"inputPerMillion": 0.5, "outputPerMillion": 0}}',
     None, [(SONNET, 1.0, 2.5), ("legacy", 0.5, 0.0)]),
    (' {"claude": {"inputPerMillion": 7, "outputPerMillion": 8, "note": "x"}}', None, [("claude", 7.0, 8.0)]),
)


def _override_oracle() -> str:
    rows, n = [], 0
    for i, (raw, reason, entries) in enumerate(_OVERRIDES):
        mine = dict((p, (a, b)) for p, a, b in entries)
        built = [(p, *mine.pop(p, (a, b))) for p, a, b in C.BUILTIN_PRICING]
        for o, (p, a, b) in enumerate([*built, *((p, *v) for p, v in mine.items())]):
            rows.append(f"({i}, {o}, '{p}', {a}::DOUBLE, {b}::DOUBLE)")
    reasons = ", ".join(f"({i}, {'NULL' if r is None else repr(r)}, {len(e)})" for i, (_, r, e) in enumerate(_OVERRIDES))
    return f""",
prices AS (SELECT * FROM (VALUES {", ".join(rows)}) t(setting, ord, prefix, pin, pout)),
reasons AS (SELECT * FROM (VALUES {reasons}) t(setting, reason, n_entries)),
u AS (SELECT event_id, model, event_id % {len(_OVERRIDES)} AS setting, input_tokens, output_tokens FROM usage),
hit AS (SELECT u.event_id, arg_min(pin, ord) AS pin, arg_min(pout, ord) AS pout
        FROM u JOIN prices p ON p.setting = u.setting AND starts_with(u.model, p.prefix) GROUP BY u.event_id)
SELECT u.event_id, u.model, r.reason, CAST(r.n_entries AS INTEGER) AS n_entries, hit.pin AS input_per_million, hit.pout AS output_per_million
FROM u JOIN reasons r ON r.setting = u.setting LEFT JOIN hit ON hit.event_id = u.event_id"""


@query("price_overrides", with_usage(_override_oracle()))
def q_price_overrides(spark, sf_dir):
    """P21, U3s, J1 per row: each call under one of ten override texts."""
    texts = ", ".join(lit(t) for t, _, _ in _OVERRIDES)
    o, p = C.override_entries_sql("raw"), C.resolved_price_sql()
    calls = usage_rows(spark, sf_dir).selectExpr(
        "event_id", "model", f"element_at(array({texts}), CAST(event_id % {len(_OVERRIDES)} AS INT) + 1) AS raw")
    return calls.selectExpr("*", f"{o['reason']} AS reason", f"{o['entries']} AS entries").selectExpr(
        "event_id", "model", "reason", "size(entries) AS n_entries", *[f"{v} AS {k}" for k, v in p.items()])


@query("median_cost_by_model", with_usage("""
SELECT model, count(*) AS calls, round(median(cost), 9) AS median_cost FROM costs
WHERE cost IS NOT NULL GROUP BY model"""))
def q_median_cost_by_model(spark, sf_dir):
    """A10: exact median (mean of the two middles for an even count) per
    model, with counts per value and a distributed running count, so a model
    with most of the calls is not one task (``operators.quantiles``)."""
    from ledgerlens.operators.quantiles import exact_median
    m = exact_median(priced_usage(spark, sf_dir), "model", "cost", "median_cost")
    return m.selectExpr("model", "n AS calls", "round(median_cost, 9) AS median_cost")
