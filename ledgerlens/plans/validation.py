"""M2 - rule flags, flag merge, confidence counts and re-validation after
edits. Narrow projections over the records; the per-rule counts are a
partial aggregate over six keys; edits are one per-document aggregate and
one equi join."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import edits as E
from ledgerlens.operators import validation as V
from ledgerlens.plans.oracle_base import round2, with_base
from ledgerlens.plans.registry import query
from ledgerlens.sources.invoices import AS_OF, derived_edits, extracted_sql, invoice_records


def _flagged(spark, sf_dir):
    # exploded as "outer", then without the empty ones: of a plain explode Spark makes a filter that holds two more copies of all rules
    return V.with_rule_flags(invoice_records(spark, sf_dir), AS_OF)


# ------------------------------------------------------------ oracle pieces
LINE_SUMS = """,
ls AS (SELECT k, list_reduce(list(coalesce(amount, 0.0::DOUBLE) ORDER BY pos),
                             lambda a, b: a + b) AS line_sum
       FROM items GROUP BY k),
src AS (SELECT inv.*, ls.line_sum FROM inv LEFT JOIN ls ON ls.k = inv.k)"""


def _any_date(x: str) -> str:
    """A date in one of the forms that documents use."""
    return "coalesce(" + ", ".join(f"try_strptime({x}, '{f}')" for f in ("%Y-%m-%d", "%m/%d/%Y", "%d-%b-%Y", "%B %d, %Y")) + ")"


def det_rows(src: str) -> str:
    """DuckDB rows (k, doc_id, rule_no, rule, severity, message) of V1-V6
    over a flat relation with sub, tax, total, bill, due, vendor_name,
    line_sum, n_items."""
    f2 = "printf('%.2f', {})".format
    comp = round2("sub + tax")
    lsr = round2("line_sum")
    bd, dd = _any_date("bill"), _any_date("due")
    parts = [
        (1, "error", f"'Math doesn''t add up: subtotal ($' || {f2('sub')} || ') + tax ($' || {f2('tax')} "
                     f"|| ') = $' || {f2(comp)} || ', but total is $' || {f2('total')} || '.'",
         f"sub IS NOT NULL AND tax IS NOT NULL AND total IS NOT NULL AND abs({comp} - total) > 0.02::DOUBLE"),
        (2, "warning", f"'Line items sum to $' || {f2(lsr)} || ', but subtotal is $' || {f2('sub')} || '.'",
         f"n_items > 0 AND sub IS NOT NULL AND abs({lsr} - sub) > 0.02::DOUBLE"),
        (3, "warning", f"'Total is $' || {f2('total')} || ', expected a positive value.'",
         "total IS NOT NULL AND total <= 0"),
        (4, "error", "'Due date (' || due || ') is before bill date (' || bill || ').'",
         f"coalesce(bill, '') <> '' AND coalesce(due, '') <> '' AND {bd} IS NOT NULL AND {dd} IS NOT NULL "
         f"AND {dd} < {bd}"),
        (5, "warning", "'Bill date (' || bill || ') is in the future.'",
         f"coalesce(bill, '') <> '' AND {bd} IS NOT NULL AND CAST({bd} AS DATE) > DATE '{AS_OF}'"),
        (6, "warning", "'Vendor name could not be extracted.'", "coalesce(vendor_name, '') = ''"),
    ]
    return "\nUNION ALL ".join(
        f"SELECT k, doc_id, {n} AS rule_no, 'V{n}' AS rule, '{sev}' AS severity, {msg} AS message "
        f"FROM {src} WHERE {cond}" for n, sev, msg, cond in parts)


@query("validation_flags", with_base(LINE_SUMS + f""",
det AS ({det_rows('src')})
SELECT doc_id, row_number() OVER (PARTITION BY k ORDER BY rule_no) - 1 AS pos, rule, severity, message
FROM det"""))
def q_validation_flags(spark, sf_dir):
    return (_flagged(spark, sf_dir).selectExpr("doc_id", "posexplode_outer(det_flags) AS (pos, f)").where("pos IS NOT NULL")
            .selectExpr("doc_id", "CAST(pos AS BIGINT) AS pos", "f.rule AS rule",
                        "f.severity AS severity", "f.message AS message"))


@query("flag_rule_counts", with_base(LINE_SUMS + f""",
det AS ({det_rows('src')})
SELECT rule, severity, count(*) AS n_flags FROM det GROUP BY rule, severity"""))
def q_flag_rule_counts(spark, sf_dir):
    return (_flagged(spark, sf_dir).selectExpr("explode_outer(det_flags) AS f").where("f IS NOT NULL")
            .groupBy("f.rule", "f.severity").agg(F.count("*").alias("n_flags"))
            .withColumnsRenamed({"f.rule": "rule", "f.severity": "severity"}))


MERGE_CTES = """,
all_flags AS (
  SELECT k, doc_id, 0 AS src, rule_no AS ord, severity, message FROM det
  UNION ALL SELECT m.k, inv.doc_id, 1, m.pos, m.severity, m.message FROM mflags m JOIN inv ON inv.k = m.k),
firsts AS (
  SELECT k, doc_id, severity, message, min(src * 1000 + ord) AS o FROM all_flags
  GROUP BY k, doc_id, severity, message)"""
MERGE_SQL = MERGE_CTES + """
SELECT doc_id, row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS pos, severity, message FROM firsts"""


@query("merged_flags", with_base(LINE_SUMS + f""",
det AS ({det_rows('src')})""" + MERGE_SQL))
def q_merged_flags(spark, sf_dir):
    return (_flagged(spark, sf_dir).selectExpr("doc_id", "posexplode_outer(merged_flags) AS (pos, f)").where("pos IS NOT NULL")
            .selectExpr("doc_id", "CAST(pos AS BIGINT) AS pos", "f.severity AS severity",
                        "f.message AS message"))


def _conf_sum(level: str) -> str:
    return " + ".join(f"CASE WHEN conf{i} = '{level}' THEN 1 ELSE 0 END" for i in range(9))


@query("confidence_summary", with_base(f"""
SELECT doc_id, CAST({_conf_sum('high')} AS BIGINT) AS high, CAST({_conf_sum('medium')} AS BIGINT) AS medium,
       CAST({_conf_sum('low')} AS BIGINT) AS low FROM inv"""))
def q_confidence_summary(spark, sf_dir):
    return invoice_records(spark, sf_dir).selectExpr("doc_id", *V.confidence_counts_sql())


# ------------------------------------------------------------------ edits
_TRIM = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')"
_PARSED = (f"TRY_CAST(nullif(regexp_extract(replace({_TRIM}, ',', ''), "
           f"'^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?', 0), '') AS DOUBLE)")
EDITS_SQL = f""",
edits0 AS (
  SELECT k, doc_id, 'total' AS field, format('{{:,.2f}}', {round2('sub + tax')}) AS raw, 2 AS ts
    FROM inv WHERE k % 9 = 0
  UNION ALL SELECT k, doc_id, 'total', 'abc', 3 FROM inv WHERE k % 18 = 0
  UNION ALL SELECT k, doc_id, 'vendor_name', '  Acme Supply Co  ', 1 FROM inv WHERE k % 23 = 0 AND k % 4 = 0
  UNION ALL SELECT k, doc_id, 'due_date', strftime(CAST(bill AS DATE) + 30, '%Y-%m-%d'), 1 FROM inv WHERE k % 17 = 0
  UNION ALL SELECT k, doc_id, 'subtotal', '   ', 1 FROM inv WHERE k % 13 = 0 AND k % 2 = 1
  UNION ALL SELECT k, doc_id, 'subtotal', '$12', 1 FROM inv WHERE k % 26 = 0),
edits1 AS (
  SELECT *, field IN ('subtotal', 'tax', 'total') AS is_money,
         CASE WHEN {_TRIM} = '' THEN NULL ELSE {_PARSED} END AS num, nullif({_TRIM}, '') AS txt,
         {_TRIM} = '' OR {_PARSED} IS NOT NULL AS num_ok
  FROM edits0),
valid AS (SELECT * FROM edits1 WHERE NOT is_money OR num_ok),
latest AS (
  SELECT k, field, arg_max(num, ts) AS num, arg_max(txt, ts) AS txt FROM valid GROUP BY k, field),
ed AS (
  SELECT inv.k, inv.doc_id, inv.n_items, ls.line_sum,
    CASE WHEN v.k IS NOT NULL THEN v.txt ELSE inv.vendor_name END AS vendor_name,
    inv.bill AS bill,
    CASE WHEN d.k IS NOT NULL THEN d.txt ELSE inv.due END AS due,
    CASE WHEN s.k IS NOT NULL THEN s.num ELSE inv.sub END AS sub,
    inv.tax AS tax,
    CASE WHEN t.k IS NOT NULL THEN t.num ELSE inv.total END AS total
  FROM inv
  LEFT JOIN ls ON ls.k = inv.k
  LEFT JOIN latest v ON v.k = inv.k AND v.field = 'vendor_name'
  LEFT JOIN latest d ON d.k = inv.k AND d.field = 'due_date'
  LEFT JOIN latest s ON s.k = inv.k AND s.field = 'subtotal'
  LEFT JOIN latest t ON t.k = inv.k AND t.field = 'total'),
det AS ({det_rows('src')}),
det_ed AS ({det_rows('ed')}),
stored0 AS (
  SELECT k, 0 AS src, rule_no AS ord, severity, message FROM det
  UNION ALL SELECT k, 1, pos, severity, message FROM mflags),
stored AS (SELECT k, severity, message, min(src * 1000 + ord) AS o FROM stored0 GROUP BY k, severity, message),
model_only AS (
  SELECT s.k, s.o, s.severity, s.message FROM stored s
  WHERE NOT EXISTS (SELECT 1 FROM det d WHERE d.k = s.k AND d.severity = s.severity AND d.message = s.message)),
disp0 AS (
  SELECT k, rule_no AS o, severity, message FROM det_ed
  UNION ALL SELECT m.k, 100000 + m.o, m.severity, m.message FROM model_only m),
disp AS (SELECT k, severity, message, min(o) AS o FROM disp0 GROUP BY k, severity, message)
SELECT 'INV-' || CAST(k AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS pos,
       severity, message FROM disp"""


@query("edit_overlay_revalidated", with_base(LINE_SUMS + EDITS_SQL))
def q_edit_overlay(spark, sf_dir):
    """J4, J7, U2s: the flags shown for every document, edited or not."""
    rec = invoice_records(spark, sf_dir)
    shown = E.with_display_flags(E.apply_edits(rec, derived_edits(rec)), AS_OF)
    return (shown.selectExpr("doc_id", "posexplode(flags) AS (pos, f)")
            .selectExpr("doc_id", "CAST(pos AS BIGINT) AS pos", "f.severity AS severity",
                        "f.message AS message"))


_CHANGED = {"vendor_name": "ed.vendor_name IS DISTINCT FROM inv.vendor_name", "due_date": "ed.due IS DISTINCT FROM inv.due",
            "subtotal": "ed.sub IS DISTINCT FROM inv.sub", "total": "ed.total IS DISTINCT FROM inv.total"}


@query("edited_markers", with_base(LINE_SUMS + EDITS_SQL.split(",\ndet AS (")[0] + "\n" + "\nUNION ALL ".join(
    f"SELECT inv.doc_id, '{f}' AS field, {_CHANGED.get(f, 'false')} AS edited FROM inv JOIN ed ON ed.k = inv.k" for f in E.EDITABLE)))
def q_edited_markers(spark, sf_dir):
    """P10: per document and header field, whether the shown value differs
    from the extracted one."""
    rec = invoice_records(spark, sf_dir)
    return E.edited_markers(E.apply_edits(rec, derived_edits(rec))).select("doc_id", "field", "edited")


@query("date_rule_flags", with_base(LINE_SUMS + f""",
exr AS (SELECT ex.k, ex.doc_id, a_subtotal AS sub, a_tax AS tax, a_total AS total, a_bill_date AS bill, a_due_date AS due,
               a_vendor_name AS vendor_name, ls.line_sum, inv.n_items
        FROM ex JOIN inv ON inv.k = ex.k LEFT JOIN ls ON ls.k = ex.k),
det AS ({det_rows('exr')})
SELECT doc_id, rule, severity, message FROM det WHERE rule_no >= 4"""))
def q_date_rule_flags(spark, sf_dir):
    """V4-V6 over the extracted copy, whose dates come in four forms and as
    texts that are no dates."""
    rec, ex = invoice_records(spark, sf_dir), extracted_sql()
    paths = {f: path for f, (path, _) in E.EDITABLE.items()}
    read = rec.selectExpr("doc_id", "record", *[f"{ex[f]} AS x_{f}" for f in paths])
    col = F.col("record")
    for f, path in paths.items():
        col = col.withField(path, F.col(f"x_{f}"))
    flags = V.rule_flags_sql(AS_OF, with_rule=True)
    return (read.select("doc_id", col.alias("record")).selectExpr("doc_id", f"inline({flags})")
            .where("rule >= 'V4'").select("doc_id", "rule", "severity", "message"))
