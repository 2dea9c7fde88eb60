"""The streams over the tables, replayed in several micro-batches: each must give what its batch query gives, and has its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import chunks as CH
from ledgerlens.plans import admission as PA
from ledgerlens.plans import costs as PC
from ledgerlens.plans import streams as PS
from ledgerlens.plans.registry import oracle_of, query
from ledgerlens.session import ensure_checkpoint_dir, open_files
from ledgerlens.sources.invoices import AS_OF
from ledgerlens.sources.usage import usage_rows

IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def replay(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], key: str | None = None, deal: tuple[str, int] | None = None) -> DataFrame:
    """Writes the parts as files, one after the other, and lets the stream take each as one micro-batch before the next arrives;
    returns what the stream has written. A part is written by as many tasks as its rows need; with ``key`` a key's rows lie in one file,
    by time. With ``deal`` (an expression and n) the one frame given is dealt into the parts 0 to n - 1 and written at once, not computed for each part;
    the stream sees a part's folder when its turn comes. Everything lies in the shared folder. (Runs the stream while the plan is built.)"""
    import uuid
    spark: SparkSession = parts[0].sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    given = spark.conf.get(IDLE, "true")
    spark.conf.set(IDLE, "false")       # an available-now run ends with its data, though its state has timers
    try:
        if deal:
            with open_files(spark, deal[1]):
                parts[0].selectExpr("*", f"CAST({deal[0]} AS INT) AS part").write.option("compression", "zstd").partitionBy("part").parquet(f"{folder}/in")
        for i in range(deal[1] if deal else len(parts)):
            if not deal:
                rows = parts[i].repartition(key).sortWithinPartitions("ts_us", "event_id") if key else parts[i]
                rows.write.parquet(f"{folder}/in/part={i}")
            here = ",".join(str(k) for k in range(i + 1))
            source = spark.readStream.schema(parts[0].schema).option("recursiveFileLookup", True).parquet(f"{folder}/in/part={{{here}}}")
            run = (make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
                   .outputMode("append").trigger(availableNow=True).start())
            run.awaitTermination()
            if run.exception():
                raise run.exception()
    finally:
        spark.conf.set(IDLE, given)
    return spark.read.parquet(f"{folder}/out")


def by_time(rows: DataFrame, n: int = 3) -> list[DataFrame]:
    """The rows in ``n`` stretches of time."""
    cuts = rows.approxQuantile("ts_us", [i / n for i in range(1, n)], 0.05)
    bounds = [None, *cuts, None]
    return [rows.where(F.lit(True) if a is None else F.col("ts_us") > a).where(F.lit(True) if b is None else F.col("ts_us") <= b)
            for a, b in zip(bounds, bounds[1:])]


@query("stream_rate_admission", oracle_of("rate_admission"))
def q_stream_rate_admission(spark, sf_dir):
    """Requests admitted as they arrive."""
    from ledgerlens.streaming.gates import stream_admission
    requests = usage_rows(spark, sf_dir).selectExpr("event_id", "CAST(user_id AS STRING) AS key", "ts_us")
    kind = dict(usage_rows(spark, sf_dir).dtypes)["user_id"]
    return replay(by_time(requests), lambda s: stream_admission(s, PA.LIMIT, PA.WINDOW_US), "key").selectExpr(
        "event_id", f"CAST(key AS {kind}) AS user_id", "ok", "remaining", "retry_after_s", "reset_at_us")


@query("stream_median_cap", oracle_of("median_cost_cap"))
def q_stream_median_cap(spark, sf_dir):
    """Costs capped as they arrive."""
    from ledgerlens.streaming.gates import stream_median_cap
    priced = PC.priced_usage(spark, sf_dir).where("cost IS NOT NULL")
    kind = dict(priced.dtypes)["user_id"]
    costs = priced.selectExpr("event_id", "CAST(user_id AS STRING) AS key", "ts_us", "cost")
    return replay(by_time(costs), stream_median_cap, "key").selectExpr("event_id", f"CAST(key AS {kind}) AS user_id", "cost", "exceeded", "cap", "median")


@query("stream_completion", oracle_of("response_completion"))
def q_stream_completion(spark, sf_dir):
    """R2: responses completed as their chunks arrive, the odd chunks of each before the even ones."""
    from ledgerlens.streaming.chunks import stream_outcomes
    src = PS.broken_responses(spark, sf_dir)
    # the last chunk is known where the text is cut: no join
    ends = src.selectExpr("doc_id AS response_id", "value AS text", "2048 AS size", "CAST(greatest(ceil(char_length(value) / 2048), 1) - 1 AS BIGINT) AS last_seq")
    chunks = CH.chunk_rows(ends, keep=("last_seq",)).selectExpr("response_id", "seq", "chunk", "seq = last_seq AS last")
    calls = src.selectExpr("doc_id AS response_id", "(order_key % 90) / 75D AS cost", "CASE WHEN order_key % 3 = 0 THEN 0.5D END AS cap")
    return replay([chunks], lambda s: stream_outcomes(s, calls, AS_OF, shown="size(record.flags) AS n_flags").select(
        "response_id", "type", "code", "message", "n_flags"), deal=("1 - seq % 2", 2))


@query("stream_validation", oracle_of("record_source"))
def q_stream_validation(spark, sf_dir):
    """Records checked as they arrive; good ones and dead letters with their reason in one result."""
    from ledgerlens.streaming.validation import validate_stream
    raw = PS.broken_responses(spark, sf_dir).select("doc_id", "value")

    def both(stream: DataFrame) -> DataFrame:
        good, dead = validate_stream(stream, AS_OF, keep=("doc_id",))
        return good.selectExpr("doc_id", "CAST(NULL AS STRING) AS error", "record.total.value AS total", "size(record.line_items) AS n_items").union(
            dead.selectExpr("doc_id", "error", "CAST(NULL AS DOUBLE) AS total", "CAST(NULL AS INT) AS n_items"))
    return replay([raw.where("crc32(doc_id) % 2 = 0"), raw.where("crc32(doc_id) % 2 = 1")], both)
