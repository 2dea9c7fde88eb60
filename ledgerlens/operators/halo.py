"""Rolling statistic over the previous N rows of a key, without putting a
key into one task.

A window ``PARTITION BY key ORDER BY t ROWS BETWEEN N PRECEDING AND 1
PRECEDING`` sends every row of a key to one task. Here the rows are range-
partitioned on (key, order) - quantiles, so a hot key spreads over many
partitions - and each partition only needs the last N rows of its first key
from the partitions before it (a *halo*). Pass 1 takes the last N rows of
each partition's last key (at most N x #partitions rows: a proven bound, so
they are broadcast); pass 2 prepends the halo and computes the statistic
locally. The range-partitioned input is checkpointed so the two passes share
one shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.session import ensure_checkpoint_dir


def rolling_median_prev(df: DataFrame, key: str, order: list[str], value: str, n: int, out: str,
                        num_partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = median of ``value`` over the previous ``n`` rows of the
    same key (null for the first row of a key)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [key, *order]
    tagged_schema = T.StructType(df.schema.fields + [T.StructField("_pid", T.IntegerType())])

    def tag(it):
        pid = TaskContext.get().partitionId()
        for pdf in it:
            yield pdf.assign(_pid=pid)
    ranged = (df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols)
              .mapInPandas(tag, tagged_schema)).checkpoint()

    tail_schema = T.StructType([T.StructField("_pid", T.IntegerType()),
                                T.StructField(key, df.schema[key].dataType),
                                T.StructField(value, df.schema[value].dataType),
                                T.StructField("_rank", T.IntegerType())])

    def tails(it):
        last = None
        for pdf in it:
            if pdf.empty:
                continue
            k = pdf[key].iloc[-1]
            cur = pdf[pdf[key] == k][[key, value, "_pid"]]
            if last is not None and last[key].iloc[-1] == k:
                cur = pd.concat([last, cur])
            last = cur.tail(n)
        if last is not None:
            yield last.assign(_rank=range(len(last)))[["_pid", key, value, "_rank"]]

    halo_rows = ranged.mapInPandas(tails, tail_schema)
    rows = halo_rows.collect()      # at most n rows per partition, by construction
    halo = pd.DataFrame([r.asDict() for r in rows], columns=["_pid", key, value, "_rank"])
    bc = spark.sparkContext.broadcast(halo)

    out_schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])

    def compute(it):
        h, tail = bc.value, None
        for pdf in it:
            if pdf.empty:
                continue
            if tail is None:
                pid, first = int(pdf["_pid"].iloc[0]), pdf[key].iloc[0]
                tail = h[(h["_pid"] < pid) & (h[key] == first)].sort_values(["_pid", "_rank"])[[key, value]].tail(n)
            vals = pd.concat([tail, pdf[[key, value]]], ignore_index=True)
            med = (vals.groupby(key, sort=False)[value]
                   .transform(lambda s: s.shift(1).rolling(n, min_periods=1).median()))
            res = pdf.drop(columns=["_pid"]).copy()
            res[out] = med.iloc[len(tail):].to_numpy()
            tail = vals[vals[key] == vals[key].iloc[-1]].tail(n)       # all that the next batch needs
            yield res
    return ranged.mapInPandas(compute, out_schema)
