"""The state store that typed state, timers and state TTL need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Typed state is kept by the RocksDB provider; the session's queries that start from now on use it."""
    if not spark.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


def with_state(df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Rows of a stream through a processor with state per ``key``, by processing time."""
    use_state_store(df.sparkSession)
    return df.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")
