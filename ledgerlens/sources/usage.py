"""Usage and request rows derived from the ``events`` table.

Per event: model by event type (one type maps to a model without a price),
``input_tokens = floor(value * 100)``, ``output_tokens = floor(value * 10)``,
``ts_us`` = epoch microseconds (UTC). Also request-log fields: route,
outcome category, duration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import ensure_utc
from ledgerlens.sources.tables import read_table

# Model ids with built-in prices, as in the app's price map.
SONNET, OPUS, HAIKU = "claude-sonnet-4-6", "claude-opus-4-7", "claude-haiku-4-5"
UNPRICED = "legacy-model-x"

MODEL_SQL = (f"CASE event_type WHEN 'signup' THEN '{SONNET}' WHEN 'purchase' THEN '{SONNET}-20250514' "
             f"WHEN 'view' THEN '{HAIKU}' WHEN 'click' THEN '{OPUS}' ELSE '{UNPRICED}' END")


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, ts, ts_us, event_type, model, input_tokens, output_tokens, value."""
    ensure_utc(spark)
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return ev.selectExpr(
        "event_id", "user_id", "CAST(ts AS TIMESTAMP) AS ts",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS ts_us", "event_type",
        f"{MODEL_SQL} AS model",
        "CAST(floor(value * 100) AS BIGINT) AS input_tokens",
        "CAST(floor(value * 10) AS BIGINT) AS output_tokens", "value")
