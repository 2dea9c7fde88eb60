"""Stateless streaming validation with dead letters. Arriving JSON
records are parsed against the record schema (S6); good rows get the rule
flags merged and the confidence counts (P3, U1s, A2); bad rows go to a
dead-letter sink with the raw text and a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens.operators import validation as V
from ledgerlens.sources.records import checked_once, parse_records


def validate_stream(raw: DataFrame, as_of: str, text_col: str = "value", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """raw: streaming rows with a JSON text column. Returns (good, dead); ``keep`` names columns that dead letters keep too."""
    good, dead = checked_once(parse_records(raw, text_col))
    good = V.validated(good, as_of).selectExpr("*", *V.confidence_counts_sql())
    return good, dead.select(*keep, text_col, "error")


def start(raw: DataFrame, as_of: str, good_path: str, dead_path: str, checkpoint: str,
          text_col: str = "value", trigger: dict | None = None):
    """Start both sinks (parquet files; one checkpoint folder each)."""
    good, dead = validate_stream(raw, as_of, text_col)
    trig = trigger or {"availableNow": True}
    q1 = (good.writeStream.format("parquet").option("path", good_path)
          .option("checkpointLocation", checkpoint + "/good").trigger(**trig).start())
    q2 = (dead.writeStream.format("parquet").option("path", dead_path)
          .option("checkpointLocation", checkpoint + "/dead").trigger(**trig).start())
    return q1, q2
