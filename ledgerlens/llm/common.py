"""Helpers shared by the training-data operators.

Text jobs hand whole documents to Arrow tasks, so their batches are held
small (``TEXT_BATCH_ROWS`` rows, ``TEXT_BATCH_BYTES`` bytes): memory in a task follows the longest
document, not the batch size. Intermediate results go to the shared folder that
the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir
from ledgerlens.sources.tables import read_table

TEXT_BATCH_ROWS = 512
TEXT_BATCH_BYTES = 16 << 20
#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of jobs that carry whole texts."""
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > TEXT_BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    text_batches(spark)
    return read_table(spark, sf_dir, "documents", *cols)


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name (not created) under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder (compressed Parquet) and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(col: Column | str, k: int = 5) -> Column:
    """crc32 of the id's text, modulo ``k``; null for a null id."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(k)


def no_text(col: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns but those that an operator's own results replace (in any case of letters)."""
    own = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in own]


def text_key(col: Column) -> Column:
    """128-bit key of a text; rows with one text share it, and every result keyed by it."""
    return F.struct(F.xxhash64(col).alias("a"), F.xxhash64(F.lit(7), col, F.length(col)).alias("b"))
