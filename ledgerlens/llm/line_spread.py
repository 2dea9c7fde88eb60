"""Line dedup by the spread over distinct sites.

A line (trimmed of ASCII white space, not empty) is boilerplate if it stands on ``MIN_SITES`` or more distinct sites.
Every line hash gets a HyperLogLog sketch of its sites, built per task and merged by aggregation. A sketch
whose estimate lies clear of the threshold decides at once; lines near it get an exact distinct count.
Boilerplate lines go from every document that has them.

Edge cases: null text is an empty text; empty lines stay; a null site counts as no site; repeated rows
are cleaned alike; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, no_text, text_key, without

MIN_SITES = 5
LG_K, SALTS = 8, 32
#: Estimates within this share of the threshold are counted exactly: over six standard errors (1.04 / 2^(LG_K/2) each).
MARGIN = 0.4


def line_spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``lines(h, site)`` -> the distinct ``h`` that stand on ``min_sites`` distinct sites or more."""
    sketch = lines.groupBy("h").agg(F.hll_sketch_agg("site", LG_K).alias("s"))
    sized = checkpoint(sketch.select("h", F.hll_sketch_estimate("s").alias("n"))
                       .where(F.col("n") >= min_sites * (1 - MARGIN)))
    sure = sized.where(F.col("n") > min_sites * (1 + MARGIN)).select("h")
    near = sized.where(F.col("n") <= min_sites * (1 + MARGIN)).select("h")
    exact = (with_lines(lines, near).distinct().groupBy("h").agg(F.count("site").alias("n"))
             .where(F.col("n") >= min_sites).select("h"))
    return checkpoint(sure.union(exact))


def with_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose ``h`` is in ``wanted``; a line with many rows is dealt out over ``SALTS`` tasks."""
    salted = lines.withColumn("salt", F.pmod(F.xxhash64(*lines.columns, F.monotonically_increasing_id()), F.lit(SALTS)))
    everywhere = wanted.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return salted.join(everywhere, ["h", "salt"], "left_semi").select(*lines.columns)


def remove_spread_lines(df: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """All rows and columns; ``text`` loses its boilerplate lines; ``n_lines`` and ``n_removed`` are added in struct
    ``spread`` (a given column of that name is replaced)."""
    split = F.split(F.col("t"), "\n")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), no_text(text).alias("t"),
                     F.col(site).cast("string").alias("site"))
    keyed = rows.select("row", "t", "site", text_key(F.col("t")).alias("key"))
    trimmed = F.btrim(F.col("line"), F.lit(" \t\n\x0b\x0c\r"))
    lines = (keyed.select("key", "site", F.posexplode(split).alias("pos", "line"))
             .select("key", "site", "pos", trimmed.alias("line")).where("line != ''")
             .select("key", "site", "pos", F.struct(F.xxhash64("line").alias("a"), F.hash("line").alias("b")).alias("h")))
    bad = line_spread(lines.select("h", "site"), min_sites)
    gone = with_lines(lines, bad).groupBy("key").agg(F.collect_set("pos").alias("gone"))
    out = keyed.join(gone, "key", "left").withColumn("lines", split)
    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i)), "\n"))
    cols = [kept.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in without(df, "spread")]
    return out.select(*cols, F.struct(F.size("lines").cast("long").alias("n_lines"),
                                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")).alias("spread"))
