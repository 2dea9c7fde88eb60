"""Result and report sinks. Per-document results and edited records go out as JSON partitioned by run date; the
accuracy and failure reports are tables built and written by Spark, one row per line of a report, so their length is not bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.sql import pct
from ledgerlens.operators import scoring

REPORT_ORDER = ("section", "ordinal", "name", "field_no")


def _write_run(out: DataFrame, path: str, run_date: str) -> None:
    """Replaces the folder of one run date; other dates stay."""
    (out.withColumn("run_date", F.lit(run_date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date").json(path))


def write_results(docs: DataFrame, path: str, run_date: str) -> None:
    """One JSON object per document (fields, pass, error)."""
    out = docs.selectExpr("doc_id", "category", "passed", "error",
                          f"{scoring.score_array_sql()} AS fields")
    _write_run(out, path, run_date)


def write_records(records: DataFrame, path: str, run_date: str, col: str = "edited") -> None:
    """One JSON object per document with its record as shown (edits applied), nulls kept."""
    _write_run(records.selectExpr("doc_id", f"to_json({col}, map('ignoreNullFields', 'false')) AS record"), path, run_date)


def accuracy_report(docs: DataFrame) -> DataFrame:
    """``section, ordinal, name, numerator, denominator, text``: the overall pass rate and field accuracy, one row per
    field (fixed order) and one per category (by name)."""
    o = scoring.accuracy_overall(docs).selectExpr(
        "inline(array(named_struct('section', 'overall', 'ordinal', 0, 'name', 'pass rate', 'numerator', passed, 'denominator', invoices), "
        "named_struct('section', 'overall', 'ordinal', 1, 'name', 'field accuracy', 'numerator', matched, 'denominator', fields)))")
    f = scoring.accuracy_by_field(docs).selectExpr("'field' AS section", "field_no AS ordinal", "field AS name", "matched AS numerator",
                                                   "total AS denominator")
    c = scoring.accuracy_by_category(docs).selectExpr("'category' AS section", "0 AS ordinal", "category AS name", "matched AS numerator",
                                                      "total AS denominator")
    return o.union(f).union(c).selectExpr("*", f"{pct('numerator', 'denominator')} AS text")


def failure_report(docs: DataFrame, n: int = 15) -> DataFrame:
    """``section, ordinal, name, category, field_no, field, expected, actual, text``: the failed fields of the ``n`` worst
    documents (worst first), then every document with an error, by id."""
    worst = scoring.bottom_failures(docs, n).selectExpr(
        "doc_id", "category", "row_number() OVER (ORDER BY failed_fields DESC, doc_id) - 1 AS ordinal")      # n rows
    detail = scoring.field_scores(docs).drop("category").where("NOT match").join(F.broadcast(worst), "doc_id")
    failed = detail.selectExpr("'failure' AS section", "ordinal", "doc_id AS name", "category", "field_no", "field", "expected", "actual",
                               "note AS text")
    errors = docs.where("error IS NOT NULL").selectExpr(
        "'error' AS section", "0 AS ordinal", "doc_id AS name", "category", "CAST(NULL AS INT) AS field_no", "CAST(NULL AS STRING) AS field",
        "CAST(NULL AS STRING) AS expected", "CAST(NULL AS STRING) AS actual", "error AS text")
    return failed.union(errors)


def write_report(report: DataFrame, path: str) -> None:
    """One row per line, as JSON, in report order across the part files."""
    keys = [F.col(k).asc_nulls_first() for k in REPORT_ORDER if k in report.columns]
    report.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)
