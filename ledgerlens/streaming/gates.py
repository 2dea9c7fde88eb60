"""R4 / R5 as streams, with typed state that lapses by its TTL.

* ``stream_admission`` - W3 with the admitted times of a key as state. Every request is decided when it arrives, however late its
  own time is; a key without requests for 24 h (processing time) is dropped, as the app evicts stale buckets by its clock.
* ``stream_median_cap`` - W1 with the last 50 accepted costs of a key as state; a key without calls for
  ``evict_after_ms`` is dropped.
* ``monthly_gate_batch`` - W2 per micro-batch with ``foreachBatch``: the batch operator's distributed prefix sum plus the month
  totals carried from earlier batches. Results and totals of a batch go to folders named by its id and are overwritten when it is
  run again, and totals are read from the latest earlier batch that has them.

Rows are decided in (event time, id) order within an Arrow batch and in
arrival order across batches, as the app decides by arrival.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.operators import costs as C
from ledgerlens.operators.folds import ABSOLUTE_CEILING_USD, CAP_MULTIPLIER, HISTORY_CAP, _median
from ledgerlens.streaming.state import with_state

ADMISSION_OUT = ("event_id long, key string, ts_us long, ok boolean, remaining long, "
                 "retry_after_s long, reset_at_us long")


class Admission(StatefulProcessor):
    """The admitted times of a key; they lapse ``evict_after_ms`` (processing time) after the key's last request."""

    def __init__(self, limit: int, window_us: int, evict_after_ms: int):
        self.limit, self.window_us, self.evict_after_ms = limit, window_us, evict_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "times array<long>", ttlDurationMs=self.evict_after_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = list(self.times.get()[0]) if self.times.exists() else []
        limit, window_us = self.limit, self.window_us
        for pdf in rows:
            pdf = pdf.sort_values(["ts_us", "event_id"])
            out = []
            for eid, t in zip(pdf["event_id"].tolist(), pdf["ts_us"].tolist()):
                times = [x for x in times if x > t - window_us]
                if len(times) >= limit:
                    oldest = times[0]
                    out.append((eid, key[0], t, False, 0, math.ceil(max(0, oldest + window_us - t) / 1e6), oldest + window_us))
                else:
                    times.append(t)
                    out.append((eid, key[0], t, True, max(0, limit - len(times)), 0, t + window_us))
            yield pd.DataFrame(out, columns=["event_id", "key", "ts_us", "ok", "remaining", "retry_after_s", "reset_at_us"])
        self.times.update(([int(x) for x in times],))

    def close(self) -> None:
        pass


def stream_admission(requests: DataFrame, limit: int, window_us: int, evict_after_ms: int = 86_400_000) -> DataFrame:
    """requests: streaming (event_id, key, ts_us)."""
    return with_state(requests, "key", Admission(limit, window_us, evict_after_ms), ADMISSION_OUT)


MEDIAN_OUT = "event_id long, key string, cost double, exceeded boolean, cap double, median double"


class MedianCap(StatefulProcessor):
    """The last accepted costs of a key. Rows keep the columns of ``carry`` and get ``exceeded``, ``cap`` and ``median``; a row
    without a cost gets nulls. With ``named`` the key is given out after the first column."""

    def __init__(self, cost: str, carry: list[str], order: list[str], evict_after_ms: int, named: bool = False):
        self.cost, self.carry, self.order, self.evict_after_ms, self.named = cost, carry, order, evict_after_ms, named

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getValueState("history", "costs array<double>", ttlDurationMs=self.evict_after_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hist = list(self.history.get()[0]) if self.history.exists() else []
        for pdf in rows:
            pdf = pdf.sort_values(self.order)
            decided = []
            for c in pdf[self.cost].tolist():
                if c is None or math.isnan(c):
                    decided.append((None, None, None))
                    continue
                med = _median(hist)
                if c > ABSOLUTE_CEILING_USD:
                    decided.append((True, ABSOLUTE_CEILING_USD, med))
                    continue
                cap = None if med is None or med == 0 else med * CAP_MULTIPLIER
                exceeded = cap is not None and c > cap
                if not exceeded and math.isfinite(c) and c >= 0:
                    hist = (hist + [c])[-HISTORY_CAP:]
                decided.append((exceeded, cap, med))
            out = pdf[self.carry].reset_index(drop=True)
            if self.named:
                out.insert(1, "key", key[0])
            for i, name in enumerate(("exceeded", "cap", "median")):
                out[name] = pd.Series([d[i] for d in decided], dtype="object" if name == "exceeded" else "float64")
            yield out
        self.history.update(([float(x) for x in hist],))

    def close(self) -> None:
        pass


def stream_median_cap(costs: DataFrame, evict_after_ms: int = 30 * 86_400_000) -> DataFrame:
    """costs: streaming (event_id, key, ts_us, cost) with non-null cost."""
    return with_state(costs, "key", MedianCap("cost", ["event_id", "cost"], ["ts_us", "event_id"], evict_after_ms, named=True), MEDIAN_OUT)


def monthly_gate_batch(state_dir: str, out_path: str, budget: float = C.MONTHLY_BUDGET_DEFAULT):
    """``foreachBatch`` handler for W2. ``state_dir`` (under the shared checkpoint folder) gets one folder per batch with the spend
    of each month so far; ``out_path`` one folder ``batch=<id>`` with its decisions."""
    def handler(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in _versions(spark, state_dir) if n < batch_id]
        carried = (spark.read.schema("month string, carried double").parquet(os.path.join(state_dir, f"v{max(earlier)}")) if earlier
                   else spark.createDataFrame([], "month string, carried double"))
        gated = C.monthly_budget_gate(batch, budget=1e300)
        g = (gated.join(carried, "month", "left")
             .withColumn("spend_before", F.coalesce("carried", F.lit(0.0)) + F.col("spend_before"))
             .withColumn("refused", F.expr(f"round(spend_before, 9) >= {budget}D")).drop("carried"))
        g.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))
        totals = (batch.selectExpr("date_format(ts, 'yyyy-MM') AS month",
                                   f"CASE WHEN {C.VALID_COST} THEN cost ELSE 0D END AS c")
                  .groupBy("month").agg(F.sum("c").alias("c"))
                  .unionByName(carried.withColumnRenamed("carried", "c"))
                  .groupBy("month").agg(F.sum("c").alias("carried")))
        totals.write.mode("overwrite").parquet(os.path.join(state_dir, f"v{batch_id}"))
    return handler


def _versions(spark, folder: str) -> list[int]:
    """Batch ids whose totals are committed (the writer's success mark is there)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return [int(p.getName()[1:]) for p in found if re.fullmatch(r"v\d+", p.getName())
            and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
