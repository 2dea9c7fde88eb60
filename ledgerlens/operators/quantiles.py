"""Exact median per group (A10) without holding a group's values in one
task.

``median``/``percentile`` keep every distinct value of a group in one
aggregation buffer, so a group with a third of all rows lands in one task.
Here: counts per (group, value) (a partial aggregate), a distributed running
count over the values of each group (``operators.prefix``: range partitions
split a hot group), and the value(s) at the middle position(s) picked by
range test - two rows per group at most. The median of an even count is the
mean of the two middle values, as the app computes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.prefix import running_sum


def exact_median(df: DataFrame, group: str, value: str, out: str = "median",
                 num_partitions: int | None = None) -> DataFrame:
    """group, n, ``out`` for non-null, non-NaN values."""
    vals = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).filter(
        "_v IS NOT NULL AND NOT isnan(_v)")
    counts = vals.groupBy("_g", "_v").agg(F.count("*").cast("double").alias("_c"))
    totals = counts.groupBy("_g").agg(F.sum("_c").cast("long").alias("n"))
    ranked = running_sum(counts, "_c", ["_g"], ["_v"], "_before", num_partitions=num_partitions)
    lo, hi = "CAST((n - 1) DIV 2 AS DOUBLE)", "CAST(n DIV 2 AS DOUBLE)"
    mid = (ranked.join(totals, "_g")
           .filter(f"_before <= {hi} AND _before + _c > {lo}")
           .selectExpr("_g", "n", f"CASE WHEN _before <= {lo} AND _before + _c > {lo} THEN _v END AS v_lo",
                       f"CASE WHEN _before <= {hi} AND _before + _c > {hi} THEN _v END AS v_hi"))
    return (mid.groupBy("_g", "n").agg(F.max("v_lo").alias("v_lo"), F.max("v_hi").alias("v_hi"))
            .selectExpr(f"_g AS {group}", "n", f"(v_lo + v_hi) / 2 AS {out}"))
