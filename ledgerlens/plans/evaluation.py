"""M1 - the evaluation run: score extracted fields against ground truth and
roll accuracy up by field, by category and overall; list the worst
documents. Spark plan: the record derivation (joins + one aggregate) and
then narrow projections and tiny partial aggregates; no further shuffle of
document rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens import schemas as S
from ledgerlens.operators import scoring
from ledgerlens.plans.oracle_base import js_num, jtrim, normalize_date, pct, with_base
from ledgerlens.plans.registry import query
from ledgerlens.sources.invoices import error_sql, extracted_sql, invoice_records


def scoring_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected (P1 of the record) and actual (the perturbed extraction) side
    by side. Both come from the same derived record, so the J3 pairing is a
    projection here; ``scoring.pair_by_doc`` is the join for separate tables."""
    gt, ex = scoring.ground_truth_sql(), extracted_sql()
    return invoice_records(spark, sf_dir).selectExpr(
        "doc_id", "category", f"{error_sql()} AS error",
        *[f"{gt[f]} AS e_{f}" for f in S.GROUND_TRUTH_FIELDS],
        *[f"{ex[f]} AS a_{f}" for f in S.GROUND_TRUTH_FIELDS])


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.document_scores(scoring_pairs(spark, sf_dir))


# ---------------------------------------------------------------- oracle SQL
def _score_sql() -> str:
    parts = []
    for i, f in enumerate(S.GROUND_TRUTH_FIELDS):
        e, a = f"e_{f}", f"a_{f}"
        if f in S.STRING_SCORED:
            match = (f"CASE WHEN {e} IS NULL THEN true WHEN {a} IS NULL THEN false "
                     f"ELSE lower({jtrim(a)}) = lower({jtrim(e)}) END")
            note = f"CASE WHEN {e} IS NOT NULL AND {a} IS NULL THEN 'actual is null' END"
            et, at = e, a
        elif f in S.DATE_SCORED:
            na, ne = normalize_date(a), normalize_date(e)
            match = (f"CASE WHEN {e} IS NULL THEN true WHEN {a} IS NULL THEN false "
                     f"WHEN {na} IS NULL OR {ne} IS NULL THEN false ELSE {na} = {ne} END")
            note = (f"CASE WHEN {e} IS NULL THEN NULL WHEN {a} IS NULL THEN 'actual is null' "
                    f"WHEN {na} IS NULL OR {ne} IS NULL THEN 'unparseable date: actual=' || {a} "
                    f"|| ' expected=' || {e} END")
            et, at = e, a
        else:
            match = (f"CASE WHEN {e} IS NULL THEN true WHEN {a} IS NULL THEN false "
                     f"ELSE abs({a} - {e}) <= 0.01::DOUBLE END")
            note = (f"CASE WHEN {e} IS NULL THEN NULL WHEN {a} IS NULL THEN 'actual is null' "
                    f"WHEN abs({a} - {e}) > 0.01::DOUBLE THEN 'diff: ' || printf('%.4f', abs({a} - {e})) END")
            et, at = js_num(e), js_num(a)
        parts.append(f"SELECT doc_id, category, {i} AS field_no, '{f}' AS field, {match} AS match, "
                     f"{et} AS expected, {at} AS actual, {note} AS note FROM ex WHERE error IS NULL")
    return ",\nscores AS (" + "\nUNION ALL ".join(parts) + ")"


SCORES = _score_sql()
DOCS = """,
docs AS (
  SELECT ex.doc_id, ex.category, ex.error,
         ex.error IS NULL AND coalesce(bool_and(s.match) FILTER (WHERE s.expected IS NOT NULL), true) AS passed,
         count(s.field) AS n_fields, count_if(s.match) AS n_matched, count_if(NOT s.match) AS n_failed
  FROM ex LEFT JOIN scores s ON s.doc_id = ex.doc_id
  GROUP BY ex.doc_id, ex.category, ex.error
)"""


@query("score_fields", with_base(SCORES + """
SELECT doc_id, field_no, field, match, expected, actual, note FROM scores"""))
def q_score_fields(spark, sf_dir):
    return scoring.field_scores(document_scores(spark, sf_dir))


@query("accuracy_by_field", with_base(SCORES + f"""
SELECT field_no, field, CAST(count_if(match) AS BIGINT) AS matched, CAST(count(*) AS BIGINT) AS total,
       {pct('count_if(match)', 'count(*)')} AS accuracy
FROM scores GROUP BY field_no, field"""))
def q_accuracy_by_field(spark, sf_dir):
    return scoring.accuracy_by_field(document_scores(spark, sf_dir))


@query("accuracy_by_category", with_base(SCORES + DOCS + f"""
SELECT category, CAST(count(*) AS BIGINT) AS invoices, CAST(sum(n_matched) AS BIGINT) AS matched,
       CAST(sum(n_fields) AS BIGINT) AS total, {pct('sum(n_matched)', 'sum(n_fields)')} AS accuracy
FROM docs GROUP BY category"""))
def q_accuracy_by_category(spark, sf_dir):
    return scoring.accuracy_by_category(document_scores(spark, sf_dir))


@query("accuracy_overall", with_base(SCORES + DOCS + f"""
SELECT CAST(count(*) AS BIGINT) AS invoices, CAST(count_if(passed) AS BIGINT) AS passed,
       CAST(sum(n_fields) AS BIGINT) AS fields, CAST(sum(n_matched) AS BIGINT) AS matched,
       {pct('count_if(passed)', 'count(*)')} AS pass_rate,
       {pct('sum(n_matched)', 'sum(n_fields)')} AS field_accuracy
FROM docs"""))
def q_accuracy_overall(spark, sf_dir):
    return scoring.accuracy_overall(document_scores(spark, sf_dir))


@query("accuracy_rollup", with_base(SCORES + """,
long AS (SELECT ex.doc_id, ex.category, s.field, s.match FROM ex LEFT JOIN scores s ON s.doc_id = ex.doc_id)
SELECT CASE WHEN grouping(field) = 0 THEN 'field' WHEN grouping(category) = 0 THEN 'category'
            ELSE 'overall' END AS level,
       coalesce(field, category, 'all') AS name,
       CAST(count(DISTINCT doc_id) AS BIGINT) AS invoices, CAST(count(field) AS BIGINT) AS total,
       CAST(count_if(match) AS BIGINT) AS matched
FROM long GROUP BY GROUPING SETS ((field), (category), ())
HAVING NOT (grouping(field) = 0 AND field IS NULL)"""))
def q_accuracy_rollup(spark, sf_dir):
    return scoring.accuracy_rollup(document_scores(spark, sf_dir))


@query("bottom_failures", with_base(SCORES + DOCS + """
SELECT doc_id, category, CAST(n_failed AS BIGINT) AS failed_fields FROM docs
WHERE NOT passed AND error IS NULL ORDER BY n_failed DESC, doc_id LIMIT 15"""))
def q_bottom_failures(spark, sf_dir):
    return scoring.bottom_failures(document_scores(spark, sf_dir))


@query("paired_scores", with_base(SCORES + DOCS + """
SELECT d.doc_id, CASE WHEN d.doc_id LIKE '%9' THEN 'no extraction' ELSE d.error END AS error,
       CASE WHEN d.doc_id LIKE '%9' THEN false ELSE d.passed END AS passed,
       CAST(CASE WHEN d.doc_id LIKE '%9' THEN 0 ELSE coalesce(d.n_matched, 0) END AS BIGINT) AS n_matched
FROM docs d"""))
def q_paired_scores(spark, sf_dir):
    """Expected and extracted values as two tables; one extraction in ten is missing and counts as an error."""
    from ledgerlens.sources.invoices import extracted_values
    rec = invoice_records(spark, sf_dir)
    pairs = scoring.pair_by_doc(scoring.ground_truth(rec, ("doc_id", "category")), extracted_values(rec).where("doc_id NOT LIKE '%9'"),
                                keep=("category",))
    return scoring.document_scores(pairs).select("doc_id", "error", "passed", "n_matched")


@query("accuracy_report", with_base(SCORES + DOCS + f""",
r AS (SELECT 'overall' AS section, 0 AS ordinal, 'pass rate' AS name, count_if(passed) AS a, count(*) AS b FROM docs
      UNION ALL SELECT 'overall', 1, 'field accuracy', sum(n_matched), sum(n_fields) FROM docs
      UNION ALL SELECT 'field', field_no, field, count_if(match), count(*) FROM scores GROUP BY field_no, field
      UNION ALL SELECT 'category', 0, category, sum(n_matched), sum(n_fields) FROM docs GROUP BY category)
SELECT section, CAST(ordinal AS INTEGER) AS ordinal, name, CAST(a AS BIGINT) AS numerator, CAST(b AS BIGINT) AS denominator, {pct('a', 'b')} AS text FROM r"""))
def q_accuracy_report(spark, sf_dir):
    """The accuracy report as a table."""
    from ledgerlens.operators.reports import accuracy_report
    return accuracy_report(document_scores(spark, sf_dir))


@query("failure_report", with_base(SCORES + DOCS + """,
worst AS (SELECT doc_id, category, row_number() OVER (ORDER BY n_failed DESC, doc_id) - 1 AS ordinal FROM docs
          WHERE NOT passed AND error IS NULL ORDER BY n_failed DESC, doc_id LIMIT 15)
SELECT 'failure' AS section, CAST(w.ordinal AS INTEGER) AS ordinal, w.doc_id AS name, w.category, s.field_no, s.field, s.expected, s.actual, s.note AS text
FROM worst w JOIN scores s ON s.doc_id = w.doc_id WHERE NOT s.match
UNION ALL SELECT 'error', 0, doc_id, category, NULL, NULL, NULL, NULL, error FROM docs WHERE error IS NOT NULL"""))
def q_failure_report(spark, sf_dir):
    """The failure report as a table."""
    from ledgerlens.operators.reports import failure_report
    return failure_report(document_scores(spark, sf_dir))
