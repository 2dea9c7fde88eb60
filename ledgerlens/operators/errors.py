"""Error taxonomy dimension (J2), PDF-outcome map (P19) and the request-log
rollups (A12, A8). The taxonomy is a 9-row literal table, so broadcasting
it is safe by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Error code, HTTP status, title (the app's taxonomy, 9 codes).
ERROR_TAXONOMY = (
    ("corrupt-PDF", 422, "We couldn't read that PDF"),
    ("oversized-PDF", 413, "That file is too large"),
    ("non-PDF", 415, "That file isn't a supported format"),
    ("not-an-invoice", 422, "This doesn't look like an invoice"),
    ("model-API-failure", 502, "The extraction model is unavailable"),
    ("rate-limited", 429, "Too many requests"),
    ("extraction-timeout", 504, "The extraction took too long"),
    ("cost-budget-exceeded", 429, "Extraction aborted to protect your budget"),
    ("monthly-budget-exhausted", 429, "Free tier exhausted for the month"),
)

# PDF parser outcome -> error code.
PDF_ERROR_MAP = (("empty_file", "corrupt-PDF"), ("not_a_pdf", "non-PDF"),
                 ("image_only", "not-an-invoice"), ("parse_failed", "corrupt-PDF"))


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, s, t, *ERROR_HELP[c]) for c, s, t in ERROR_TAXONOMY],
                                 "code string, http_status int, title string, message string, next_step string")


def describe_errors(df: DataFrame, code_col: str = "code") -> DataFrame:
    """Broadcast hash left join to the 9-row taxonomy."""
    t = taxonomy(df.sparkSession).withColumnRenamed("code", "_code")
    return (df.join(F.broadcast(t), F.col(code_col) == F.col("_code"), "left").drop("_code"))


def pdf_error_code_sql(outcome: str) -> str:
    """P19 as a literal map lookup."""
    pairs = ", ".join(f"'{a}', '{b}'" for a, b in PDF_ERROR_MAP)
    return f"try_element_at(map({pairs}), {outcome})"


#: What to tell the user, in our own words: what happened, what to do.
ERROR_HELP = {
    "corrupt-PDF": ("The file could not be read as a PDF.", "Save it again as a plain PDF and retry."),
    "oversized-PDF": ("The file is over the size limit for its kind.", "Compress it or lower its resolution."),
    "non-PDF": ("Only PDF and common image files are read.", "Export the document as a PDF or an image."),
    "not-an-invoice": ("No invoice fields were found in the file.", "Check that it is an invoice, or scan it more sharply."),
    "model-API-failure": ("The extraction service failed after its retries.", "Wait a minute and retry."),
    "rate-limited": ("The request limit of this client is used up.", "Wait until the window resets."),
    "extraction-timeout": ("The service did not answer in time.", "Split long documents, or retry once."),
    "cost-budget-exceeded": ("The call cost more than the safety cap.", "Check whether the document is unusually large."),
    "monthly-budget-exhausted": ("The budget of this month is spent.", "Wait for the next month."),
}


def log_rollup(logs: DataFrame) -> DataFrame:
    """Requests by route x category: count, errors and their share,
    retries, mean and longest latency, cost (partial aggregate; the keys are few). Percentiles: ``latency_percentiles``."""
    return (logs.groupBy("route", "category").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("http_status") >= 400).alias("errors"),
        F.round(F.count_if(F.col("http_status") >= 400) / F.count("*"), 6).alias("error_share"),
        F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retries"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.round(F.avg("duration_ms"), 3).alias("avg_duration_ms"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost_usd")))


def batch_summary(entries: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Per batch, success / error / pending counts, total cost (null as
    0) and whether any cost is known."""
    return (entries.groupBy(batch_col).agg(
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "error").alias("error"),
        F.count_if(F.col("status").isin("queued", "loading")).alias("pending"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"),
        F.expr("bool_or(cost IS NOT NULL)").alias("any_cost")))


#: Sketch size, and the rank error that its estimates keep (over twice the error stated for this size at 99 % confidence).
SKETCH_K, RANK_ERROR = 400, 0.02
PERCENTILES = (0.5, 0.95, 0.99)
LEVELS = ("hour", "day", "route", "all")


def latency_sketches(logs: DataFrame) -> DataFrame:
    """One mergeable sketch of the latencies for each route, category and hour (a partial aggregate: rows never meet)."""
    return (logs.where("duration_ms IS NOT NULL").groupBy("route", "category", F.date_trunc("hour", "ts").alias("hour"))
            .agg(F.expr(f"kll_sketch_agg_bigint(duration_ms, {SKETCH_K})").alias("sketch"), F.count("*").alias("n"),
                 F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms")))


def _level_sql() -> str:
    """The groups that an hour's row belongs to: (level, route, category, period)."""
    rows = ("named_struct('level', 'hour', 'route', route, 'category', category, 'period', date_format(hour, 'yyyy-MM-dd HH'))",
            "named_struct('level', 'day', 'route', route, 'category', category, 'period', date_format(hour, 'yyyy-MM-dd'))",
            "named_struct('level', 'route', 'route', route, 'category', CAST(NULL AS STRING), 'period', CAST(NULL AS STRING))",
            "named_struct('level', 'all', 'route', CAST(NULL AS STRING), 'category', CAST(NULL AS STRING), 'period', CAST(NULL AS STRING))")
    return f"explode(array({', '.join(rows)}))"


def latency_percentiles(sketches: DataFrame) -> DataFrame:
    """Hour sketches merged upward to days, routes and the total; ``quantiles`` has the estimates of ``PERCENTILES``. A group of
    up to ``SKETCH_K`` calls is held whole, so its estimates are exact."""
    rows = sketches.selectExpr(f"{_level_sql()} AS g", "sketch", "n", "min_ms", "max_ms")
    merged = rows.groupBy("g").agg(F.expr("kll_merge_agg_bigint(sketch)").alias("sketch"), F.sum("n").alias("n"),
                                   F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"))
    ps = ", ".join(f"{p}D" for p in PERCENTILES)
    return merged.selectExpr("g.*", "n", "min_ms", "max_ms", f"kll_sketch_get_quantile_bigint(sketch, array({ps})) AS quantiles")


def percentile_ranks(logs: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimates with ``below`` and ``upto``: for each of them the exact share of the group's calls that took less, and no more.
    Calls are counted by latency first, so a group of many calls is no task of its own."""
    counts = (logs.where("duration_ms IS NOT NULL").groupBy("route", "category", F.date_trunc("hour", "ts").alias("hour"), "duration_ms")
              .agg(F.count("*").alias("c")))
    held = counts.selectExpr(f"{_level_sql()} AS g", "duration_ms", "c").groupBy("g", "duration_ms").agg(F.sum("c").alias("c"))
    est = estimates.withColumn("g", F.struct("level", "route", "category", "period"))
    here = held.withColumn("key", F.to_json("g", {"ignoreNullFields": "false"})).drop("g").join(
        est.withColumn("key", F.to_json("g", {"ignoreNullFields": "false"})).select("key", "quantiles"), "key")
    parts = [F.sum(F.when(cond(F.col("duration_ms"), F.get("quantiles", i)), F.col("c")).otherwise(0)).alias(f"{name}{i}")
             for i in range(len(PERCENTILES)) for name, cond in (("lt", lambda a, b: a < b), ("le", lambda a, b: a <= b))]
    ranks = here.groupBy("key").agg(*parts)
    out = est.withColumn("key", F.to_json("g", {"ignoreNullFields": "false"})).drop("g").join(ranks, "key")
    return out.select(*estimates.columns, F.array(*[F.col(f"lt{i}") / F.col("n") for i in range(len(PERCENTILES))]).alias("below"),
                      F.array(*[F.col(f"le{i}") / F.col("n") for i in range(len(PERCENTILES))]).alias("upto"))
