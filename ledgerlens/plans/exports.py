"""M3 - CSV lines, webhook payloads. Per-record projections; the CSV file
sink range-partitions by document id only when writing."""

from __future__ import annotations

from ledgerlens.operators import exports as X
from ledgerlens.operators import validation as V
from ledgerlens.plans.oracle_base import js_num, jtrim, with_base
from ledgerlens.plans.registry import query
from ledgerlens.plans.validation import LINE_SUMS, MERGE_CTES, det_rows
from ledgerlens.sources.invoices import AS_OF, invoice_records


def _validated(spark, sf_dir):
    return V.validated(invoice_records(spark, sf_dir), AS_OF)


def cell(x: str, numeric: bool = False) -> str:
    s = js_num(x) if numeric else x
    return (f"(CASE WHEN {s} IS NULL THEN '' WHEN regexp_matches({s}, '[\",\\r\\n]') OR {jtrim(s)} <> {s} "
            f"THEN '\"' || replace({s}, '\"', '\"\"') || '\"' ELSE {s} END)")


MERGED = LINE_SUMS + f""",
det AS ({det_rows('src')})""" + MERGE_CTES + """,
merged AS (SELECT k, doc_id, row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS pos, severity, message
           FROM firsts)"""

SUMMARY_SQL = MERGED + f""",
memo AS (SELECT k, string_agg(description, ' | ' ORDER BY pos) AS memo FROM items
         WHERE description IS NOT NULL AND description <> '' GROUP BY k),
fl AS (SELECT k, string_agg(severity || ': ' || message, '; ' ORDER BY pos) AS flags FROM merged GROUP BY k)
SELECT inv.doc_id, concat_ws(',', {cell('inv_no')}, {cell('vendor_name')}, {cell('vendor_address')},
  {cell('bill')}, {cell('due')}, {cell('po')}, {cell('sub', True)}, {cell('tax', True)},
  {cell('total', True)}, {cell('currency')}, {cell("coalesce(memo.memo, '')")},
  {cell("coalesce(fl.flags, '')")}) AS line
FROM inv LEFT JOIN memo ON memo.k = inv.k LEFT JOIN fl ON fl.k = inv.k"""


@query("csv_summary_lines", with_base(SUMMARY_SQL))
def q_csv_summary(spark, sf_dir):
    return X.summary_lines(_validated(spark, sf_dir))


@query("csv_line_item_lines", with_base(f"""
SELECT inv.doc_id, CAST(items.pos AS BIGINT) AS item_pos,
  concat_ws(',', {cell('inv_no')}, {cell('vendor_name')}, {cell('bill')}, {cell('due')},
  {cell('total', True)}, {cell('currency')}, {cell('items.description')}, {cell('items.quantity', True)},
  {cell('items.unit_price', True)}, {cell('items.amount', True)}) AS line
FROM inv LEFT JOIN items ON items.k = inv.k"""))
def q_csv_line_items(spark, sf_dir):
    return X.line_item_lines(_validated(spark, sf_dir))


def _conf_sum(level: str) -> str:
    return " + ".join(f"CASE WHEN conf{i} = '{level}' THEN 1 ELSE 0 END" for i in range(9))


@query("webhook_payload", with_base(MERGED + f"""
SELECT inv.doc_id, 'invoice.extracted' AS event,
  substr(md5(inv.doc_id), 1, 8) || '-' || substr(md5(inv.doc_id), 9, 4) || '-' || substr(md5(inv.doc_id), 13, 4)
    || '-' || substr(md5(inv.doc_id), 17, 4) || '-' || substr(md5(inv.doc_id), 21, 12) AS correlation_id,
  CAST(NULL AS VARCHAR) AS idempotency_key, inv.inv_no AS invoice_number, inv.total AS total,
  CAST(inv.n_items AS BIGINT) AS n_items,
  CAST((SELECT count(*) FROM merged m WHERE m.k = inv.k) AS BIGINT) AS n_flags,
  false AS has_reasoning,
  CAST({_conf_sum('high')} AS BIGINT) AS high, CAST({_conf_sum('medium')} AS BIGINT) AS medium,
  CAST({_conf_sum('low')} AS BIGINT) AS low
FROM inv"""))
def q_webhook_payload(spark, sf_dir):
    p = X.webhook_payloads(_validated(spark, sf_dir))
    return p.selectExpr(
        "doc_id", "event", "correlation_id", "idempotency_key",
        "get_json_object(payload, '$.invoice.invoice_number.value') AS invoice_number",
        "invoice.total.value AS total",
        "CAST(size(invoice.line_items) AS BIGINT) AS n_items",
        "CAST(size(invoice.flags) AS BIGINT) AS n_flags",
        "instr(payload, '\"reasoning\"') > 0 AS has_reasoning",
        "confidence_summary.high AS high", "confidence_summary.medium AS medium",
        "confidence_summary.low AS low")
