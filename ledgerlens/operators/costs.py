"""Pricing and spend: price map with overrides (P21, U3s), model -> price
by prefix (J1), call cost (F5), monthly spend (A9, F11), monthly budget gate
(W2) and the budget setting parse (P20).

J1 matches a model id with the first key of the price map that it starts
with. A map of up to ``INLINE_PRICES`` entries (the built-ins and most
override texts) becomes an expression, so usage rows are not shuffled at
all; a longer map is joined by equality on the prefixes of the distinct models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.sql import js_trim, lit
from ledgerlens.operators.prefix import running_sum
from ledgerlens.sources.usage import HAIKU, OPUS, SONNET

# Built-in prices per million tokens (input, output), in map order.
BUILTIN_PRICING = ((SONNET, 3.0, 15.0), (OPUS, 15.0, 75.0), (HAIKU, 1.0, 5.0))
MONTHLY_BUDGET_DEFAULT = 25.0
INLINE_PRICES = 1_000        # a price map up to this size is part of the plan; a longer one is joined


def builtin_pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(p, i, o, n) for n, (p, i, o) in enumerate(BUILTIN_PRICING)],
        "prefix string, input_per_million double, output_per_million double, ord int")


def parse_pricing_overrides(spark: SparkSession, raw: str | None) -> tuple[DataFrame, str | None]:
    """The override text is a JSON object of
    ``{inputPerMillion >= 0, outputPerMillion >= 0}`` entries; any bad entry
    discards all overrides. Returns (entries, reason) with reason one of
    ``non-json``, ``non-object``, ``invalid-entry`` or None."""
    empty = spark.createDataFrame([], "prefix string, input_per_million double, "
                                      "output_per_million double, ord int")
    if raw is None or raw.strip() == "":
        return empty, None
    one = spark.createDataFrame([(raw,)], "raw string").selectExpr("try_parse_json(raw) AS v")
    entries = one.selectExpr("v", "schema_of_variant(v) AS t").selectExpr(
        "CASE WHEN v IS NULL THEN 'non-json' WHEN t NOT LIKE 'OBJECT%' THEN 'non-object' END AS reason",
        "CASE WHEN t LIKE 'OBJECT%' THEN v END AS v")
    head = entries.collect()[0]          # one row: the config text itself
    if head["reason"]:
        return empty, head["reason"]
    # keys in text order (JSON.parse keeps insertion order; variant objects sort keys)
    ordered = spark.createDataFrame([(raw,)], "raw string").selectExpr(
        "posexplode(from_json(raw, 'MAP<STRING, STRING>')) AS (pos, key, vtext)")
    rows = ordered.selectExpr("pos", "key", "try_parse_json(vtext) AS value").selectExpr(
        "pos", "key",
        "try_variant_get(value, '$.inputPerMillion', 'double') AS i",
        "try_variant_get(value, '$.outputPerMillion', 'double') AS o",
        "schema_of_variant(value) AS t",
        "schema_of_variant(try_variant_get(value, '$.inputPerMillion', 'variant')) AS ti",
        "schema_of_variant(try_variant_get(value, '$.outputPerMillion', 'variant')) AS to_")
    numeric = "({x} RLIKE '^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$')"
    ok = (f"t LIKE 'OBJECT%' AND {numeric.format(x='ti')} AND {numeric.format(x='to_')} "
          "AND i >= 0 AND o >= 0 AND abs(i) < double('Infinity') AND abs(o) < double('Infinity')")
    checked = rows.selectExpr("key AS prefix", "i AS input_per_million", "o AS output_per_million",
                              "CAST(100 + pos AS INT) AS ord", f"coalesce({ok}, false) AS ok")
    if checked.filter("NOT ok").limit(1).count() > 0:
        return empty, "invalid-entry"
    return checked.drop("ok"), None


def override_entries_sql(raw: str = "raw") -> dict[str, str]:
    """P21 per row: ``reason`` (null when the text is empty or good) and ``entries``, the override entries as
    array<struct<prefix, input_per_million, output_per_million>> in text order (empty unless good)."""
    price = "STRUCT<inputPerMillion: DOUBLE, outputPerMillion: DOUBLE>"
    kind = f"schema_of_variant(try_parse_json({raw}))"
    values = f"map_values(from_json({raw}, 'MAP<STRING, STRING>'))"
    number = "RLIKE '^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$'"

    def good(v: str, key: str) -> str:
        x = f"try_parse_json({v})"
        n = f"try_variant_get({x}, '$.{key}', 'double')"
        return (f"coalesce(schema_of_variant({x}) LIKE 'OBJECT%' AND schema_of_variant(try_variant_get({x}, '$.{key}', 'variant')) {number} "
                f"AND {n} >= 0 AND {n} < double('Infinity'), false)")
    fine = f"forall({values}, v -> {good('v', 'inputPerMillion')} AND {good('v', 'outputPerMillion')})"
    blank = f"coalesce({js_trim(raw)}, '') = ''"
    reason = (f"CASE WHEN {blank} THEN CAST(NULL AS STRING) WHEN {kind} IS NULL THEN 'non-json' WHEN {kind} NOT LIKE 'OBJECT%' THEN 'non-object' "
              f"WHEN NOT coalesce({fine}, false) THEN 'invalid-entry' END")
    entries = (f"CASE WHEN {blank} OR ({reason}) IS NOT NULL THEN array() ELSE transform(map_entries(from_json({raw}, 'MAP<STRING, {price}>')), "
               "e -> named_struct('prefix', e.key, 'input_per_million', e.value.inputPerMillion, 'output_per_million', e.value.outputPerMillion)) END")
    return {"reason": reason, "entries": entries}


def resolved_price_sql(entries: str = "entries", model: str = "model") -> dict[str, str]:
    """U3s + J1 per row: the price of ``model`` under the built-ins with the row's overrides laid over them (a built-in
    keeps its place in map order; new keys follow)."""
    built = ", ".join(f"named_struct('prefix', {lit(p)}, 'input_per_million', {i!r}D, 'output_per_million', {o!r}D)"
                      for p, i, o in BUILTIN_PRICING)
    over = f"coalesce(try_element_at(filter({entries}, e -> e.prefix = b.prefix), 1), b)"
    fresh = f"filter({entries}, e -> NOT exists(array({built}), b -> b.prefix = e.prefix))"
    hit = (f"try_element_at(filter(concat(transform(array({built}), b -> {over}), {fresh}), "
           f"e -> startswith({model}, e.prefix)), 1)")
    return {"input_per_million": f"{hit}.input_per_million", "output_per_million": f"{hit}.output_per_million"}


def resolve_pricing(builtins: DataFrame, overrides: DataFrame) -> DataFrame:
    """U3s: overrides replace built-ins by key (keeping the built-in
    position); new keys follow in override order."""
    u = (builtins.withColumn("priority", F.lit(0))
         .unionByName(overrides.withColumn("priority", F.lit(1))))
    return (u.groupBy("prefix").agg(
        F.min("ord").alias("ord"),
        F.max_by(F.struct("input_per_million", "output_per_million"), "priority").alias("p"))
        .selectExpr("prefix", "p.input_per_million", "p.output_per_million", "ord"))


def price_sql(entries: list, model: str = "model") -> tuple[str, str]:
    """J1 as expressions: input and output price of the first entry (map order) whose prefix starts the model id."""
    def pick(i: int) -> str:
        cases = " ".join(f"WHEN startswith({model}, {lit(e[0])}) THEN {float(e[i])!r}D" for e in entries)
        return f"CASE {cases} END" if entries else "CAST(NULL AS DOUBLE)"
    return pick(1), pick(2)


def model_prices(models: DataFrame, pricing: DataFrame) -> DataFrame:
    """J1 as a join, for a price map of any length: every prefix of each distinct model id meets the map by equality;
    the entry that is first in map order wins. Models with none are absent."""
    m = models.where("model is not null").select("model").distinct().selectExpr(
        "model", "explode(sequence(0, char_length(model))) AS n").selectExpr("model", "substr(model, 1, n) AS prefix")
    return (m.join(pricing, "prefix").groupBy("model")
            .agg(F.min_by(F.struct("input_per_million", "output_per_million"), "ord").alias("p"))
            .selectExpr("model", "p.input_per_million", "p.output_per_million"))


def call_costs(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """``in/1e6*pin + out/1e6*pout``; null when the model has no price
    (the call is refused before any work). Only up to ``INLINE_PRICES`` map entries reach the driver."""
    cost = "CAST(input_tokens AS DOUBLE) / 1e6 * {} + CAST(output_tokens AS DOUBLE) / 1e6 * {} AS cost"
    head = pricing.orderBy("ord").limit(INLINE_PRICES + 1).collect()
    if len(head) <= INLINE_PRICES:
        return usage.selectExpr("*", cost.format(*price_sql(
            [(r["prefix"], r["input_per_million"], r["output_per_million"]) for r in head])))
    return usage.join(model_prices(usage, pricing), "model", "left").selectExpr(
        *usage.columns, cost.format("input_per_million", "output_per_million"))


VALID_COST = "(cost IS NOT NULL AND NOT isnan(cost) AND cost >= 0 AND cost < double('Infinity'))"


def monthly_spend(costs: DataFrame) -> DataFrame:
    """Spend per UTC month; non-finite and negative costs ignored
    (the tracker includes calls that the per-call cap later rejects)."""
    return (costs.selectExpr("date_format(ts, 'yyyy-MM') AS month", "cost",
                             f"CASE WHEN {VALID_COST} THEN cost END AS valid_cost")
            .groupBy("month").agg(F.count("*").alias("calls"), F.count("cost").alias("priced_calls"),
                                  F.round(F.coalesce(F.sum("valid_cost"), F.lit(0.0)), 6).alias("spend")))


def monthly_budget_gate(costs: DataFrame, budget: float = MONTHLY_BUDGET_DEFAULT,
                        num_partitions: int | None = None) -> DataFrame:
    """A call is refused when the month's spend before it reaches the
    budget. Exact without a sequential fold: costs are >= 0, so once the
    running sum crosses the budget every later call of the month is refused,
    whatever refused calls would have added.

    The running sum is a two-phase distributed prefix sum (range partitions
    on (month, ts, event_id), local sums, broadcast partition offsets), so a
    month never has to fit in one task."""
    src = costs.selectExpr("*", "date_format(ts, 'yyyy-MM') AS month",
                           f"CASE WHEN {VALID_COST} THEN cost ELSE 0D END AS _c")
    rs = running_sum(src, "_c", ["month"], ["ts", "event_id"], "spend_before",
                     num_partitions=num_partitions)
    return rs.selectExpr("*", f"round(spend_before, 9) >= {budget}D AS refused").drop("_c")


def budget_setting(raw_col: str = "raw") -> list[str]:
    """P20: strict ``^\\d+(\\.\\d+)?$`` after trim; malformed -> default 25 with
    reason ``non-numeric``; <= 0 -> default with ``non-positive``; missing or
    empty -> default, no reason."""
    t = js_trim(raw_col)
    num = f"try_cast({t} AS DOUBLE)"
    return [
        f"CASE WHEN {raw_col} IS NULL OR {raw_col} = '' THEN {MONTHLY_BUDGET_DEFAULT}D "
        f"WHEN NOT {t} RLIKE '^\\\\d+(\\\\.\\\\d+)?$' THEN {MONTHLY_BUDGET_DEFAULT}D "
        f"WHEN {num} <= 0 THEN {MONTHLY_BUDGET_DEFAULT}D ELSE {num} END AS budget",
        f"CASE WHEN {raw_col} IS NULL OR {raw_col} = '' THEN CAST(NULL AS STRING) "
        f"WHEN NOT {t} RLIKE '^\\\\d+(\\\\.\\\\d+)?$' THEN 'non-numeric' "
        f"WHEN {num} <= 0 THEN 'non-positive' END AS reason",
    ]


__all__ = ["builtin_pricing", "parse_pricing_overrides", "resolve_pricing", "model_prices",
           "call_costs", "monthly_spend", "monthly_budget_gate", "budget_setting"]
