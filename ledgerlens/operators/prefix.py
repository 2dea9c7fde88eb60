"""Distributed running (prefix) sum.

A running sum ordered by time within a coarse group (a month of all
requests) must not put the whole group into one task. Two phases:

1. range-partition on (group, order...) - quantiles of the sort key, so a
   hot group or a hot instant is split across partitions - and compute the
   local exclusive cumulative sum per partition and group (pandas, Arrow
   batches, state carried across batches);
2. sum each (partition, group), turn those totals into offsets with a tiny
   window, and add the offsets back with a broadcast join. The offsets
   table has at most (#partitions + #groups) rows; it is counted before it
   is broadcast and joined by shuffle above the bound.

The partition-local result is checkpointed to the session's checkpoint
folder, so the totals job does not redo the range shuffle and a lost
executor does not lose it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import ensure_checkpoint_dir

MAX_BROADCAST_OFFSETS = 1_000_000


def _local_cumsum(value: str, group: list[str]):
    def fn(it):
        pid = TaskContext.get().partitionId()
        last_key, carry = None, 0.0
        for pdf in it:
            if pdf.empty:
                continue
            v = pd.to_numeric(pdf[value], errors="coerce").fillna(0.0).to_numpy(dtype=float)
            keys = list(zip(*[pdf[g].tolist() for g in group]))
            n = len(keys)
            seg = np.empty(n, dtype=np.int64)
            s = 0
            for i in range(n):
                if i > 0 and keys[i] != keys[i - 1]:
                    s += 1
                seg[i] = s
            sv = pd.Series(v)
            incl = sv.groupby(seg).cumsum()
            # exclusive sum = previous inclusive value within the segment
            excl = incl.groupby(seg).shift(1).fillna(0.0).to_numpy()
            if last_key is not None and keys[0] == last_key:
                first = seg == 0
                excl = np.where(first, excl + carry, excl)
                carry_add = carry
            else:
                carry_add = 0.0
            last_seg = seg[-1]
            last_total = float(incl.to_numpy()[-1]) + (carry_add if last_seg == 0 else 0.0)
            last_key, carry = keys[-1], last_total
            out = pdf.copy()
            out["_pid"] = pid
            out["_local"] = excl
            yield out
    return fn


def running_sum(df: DataFrame, value: str, group: list[str], order: list[str], out: str,
                num_partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = sum of ``value`` over the rows of the same ``group``
    that come before this row in ``order`` (exclusive; 0 for the first)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = group + order
    schema = T.StructType(df.schema.fields + [T.StructField("_pid", T.IntegerType()),
                                              T.StructField("_local", T.DoubleType())])
    local = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
             .mapInPandas(_local_cumsum(value, group), schema)).checkpoint()
    totals = local.groupBy("_pid", *group).agg(F.sum(value).alias("_tot"))
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *group, F.coalesce(F.sum("_tot").over(w), F.lit(0.0)).alias("_off"))
    small = offsets.limit(MAX_BROADCAST_OFFSETS + 1).count() <= MAX_BROADCAST_OFFSETS
    right = F.broadcast(offsets) if small else offsets
    return (local.join(right, ["_pid", *group])
            .select(*df.columns, (F.col("_off") + F.col("_local")).alias(out)))
