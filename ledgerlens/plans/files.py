"""Sources and sinks over files that Spark writes from the tables: logs, an evaluation corpus, dated exports, previews, progress."""

from __future__ import annotations

import uuid

from ledgerlens.operators import chunks as CH
from ledgerlens.operators import exports as X
from ledgerlens.operators import validation as V
from ledgerlens.plans import exports as _exports  # noqa: F401  (registers the line queries)
from ledgerlens.plans.costs import with_usage
from ledgerlens.plans.intake import LOGS_CTE, request_logs
from ledgerlens.plans.oracle_base import with_base
from ledgerlens.plans.registry import oracle_of, query
from ledgerlens.session import ensure_checkpoint_dir
from ledgerlens.sources.invoices import AS_OF, invoice_records
from ledgerlens.sources.tables import read_table


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("log_source", with_usage(LOGS_CTE + """
SELECT 'corr-' || CAST(event_id AS VARCHAR) AS correlation_id, CASE WHEN http_status >= 400 THEN 'error' ELSE 'info' END AS level, route,
       category, CAST(http_status AS INTEGER) AS http_status, duration_ms, CAST(retry_count AS INTEGER) AS retry_count FROM logs2"""))
def q_log_source(spark, sf_dir):
    """Request logs written as JSON lines with keys that don't belong there, and read by the allowlist."""
    from ledgerlens.sources.records import LOG_SCHEMA, read_logs
    path = scratch(spark, "logs")
    (request_logs(spark, sf_dir).selectExpr(
        "ts", "CASE WHEN http_status >= 400 THEN 'error' ELSE 'info' END AS level", "concat('corr-', CAST(event_id AS STRING)) AS correlation_id",
        "route", "category", "http_status", "duration_ms", "retry_count", "'INV-1' AS invoice_number", "'text' AS pdf_text").write.json(path))
    logs = read_logs(spark, path)
    if logs.columns != LOG_SCHEMA.names:
        raise ValueError("a log has keys that are not allowed")
    return logs.select("correlation_id", "level", "route", "category", "http_status", "duration_ms", "retry_count")


@query("response_previews", """
SELECT page_id, substr(html, 1, 500) AS body, substr(html, 1, 60) AS line FROM pages""")
def q_response_previews(spark, sf_dir):
    """The first 500 characters of a response, and 60 for an error line."""
    return read_table(spark, sf_dir, "pages", "page_id", "html").selectExpr(
        "page_id", f"{X.preview_sql('html')} AS body", f"{X.preview_sql('html', 60)} AS line")


_PHASE = "CASE event_type WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'extracting' WHEN 'signup' THEN 'retry' END"
_TYPE = "CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'progress' END"


@query("progress_rollup", f"""
SELECT type, phase, count(*) AS events, count(DISTINCT response_id) AS responses, round(avg(elapsed_ms), 3) AS avg_elapsed_ms, max(elapsed_ms) AS max_elapsed_ms
FROM (SELECT 'r' || CAST(user_id AS VARCHAR) AS response_id, {_TYPE} AS type, {_PHASE} AS phase,
             CASE WHEN {_TYPE} = 'progress' THEN CAST(floor(value * 10) AS BIGINT) END AS elapsed_ms FROM events) t
GROUP BY type, phase""")
def q_progress_rollup(spark, sf_dir):
    """R3 over the events as progress, closing and error events of streamed responses."""
    events = read_table(spark, sf_dir, "events", "user_id", "event_type", "value").selectExpr(
        "concat('r', CAST(user_id AS STRING)) AS response_id", f"{_TYPE} AS type", f"{_PHASE} AS phase",
        f"CASE WHEN {_TYPE} = 'progress' THEN CAST(floor(value * 10) AS BIGINT) END AS elapsed_ms")
    return CH.progress_rollup(events)


def _exports_oracle() -> str:
    parts = []
    for fmt, lines in (("summary", "csv_summary_lines"), ("line_items", "csv_line_item_lines")):
        parts.append(f"SELECT '{X.export_name(fmt, '2026-01-01')}' AS file, line FROM ({oracle_of(lines)}) t "
                     f"UNION ALL SELECT '{X.export_name(fmt, '2026-01-01')}', '{X.header_line(fmt)}'")
    return " UNION ALL ".join(parts)


@query("dated_exports", _exports_oracle())
def q_dated_exports(spark, sf_dir):
    """A day's exports in both formats under their names, read back. The part files are compressed: plain, the
    two texts are half of all the bytes that the job moves and writes."""
    folder, rec, out = scratch(spark, "exports"), V.validated(invoice_records(spark, sf_dir), AS_OF), None
    for fmt, path in X.write_exports(rec, folder, "2026-01-01", compression="gzip").items():
        lines = spark.read.option("lineSep", "\r\n").text(path).selectExpr(f"'{X.export_name(fmt, '2026-01-01')}' AS file", "value AS line")
        out = lines if out is None else out.union(lines)
    return out


@query("corpus_fixtures", with_base("""
SELECT doc_id AS folder, category, inv_no AS invoice_number, total, CASE WHEN k % 19 = 0 THEN 'expected.json' WHEN k % 13 = 0 THEN 'meta.json' END AS missing
FROM inv"""))
def q_corpus_fixtures(spark, sf_dir):
    """Expected values and metadata of every document as two tables, some without one part; a document with both is a fixture,
    another is skipped with the missing part named."""
    from ledgerlens.sources.fixtures import complete_or_skipped
    rec = invoice_records(spark, sf_dir).select("doc_id", "order_key", "category", "record")
    expected = rec.where("order_key % 19 <> 0").selectExpr("doc_id AS folder", "record.invoice_number.value AS invoice_number", "record.total.value AS total")
    meta = rec.where("order_key % 13 <> 0 OR order_key % 19 = 0").selectExpr("doc_id AS folder", "doc_id AS id", "category")
    path = scratch(spark, "corpus")
    expected.write.json(f"{path}/expected")
    meta.write.json(f"{path}/meta")
    e = spark.read.schema("folder string, invoice_number string, total double").json(f"{path}/expected")
    m = spark.read.schema("folder string, id string, category string").json(f"{path}/meta")
    whole, skipped = complete_or_skipped({"expected.json": e, "meta.json": m})
    named = rec.selectExpr("doc_id AS folder", "category", "record.invoice_number.value AS invoice_number", "record.total.value AS total")
    return whole.selectExpr("folder", "category", "invoice_number", "total", "CAST(NULL AS STRING) AS missing").union(
        skipped.join(named, "folder").select("folder", "category", "invoice_number", "total", "missing"))
