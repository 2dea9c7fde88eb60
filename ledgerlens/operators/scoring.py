"""Evaluation: flatten records to ground truth (P1), pair expected with
actual (J3), score fields (F1-F4), roll accuracy up (A3-A7, A11) and pick
the worst documents (T1).

Scoring is a narrow projection: per document, flat match/note columns and
plain arithmetic (no higher-order functions, so it stays in whole-stage
codegen). Rollups are partial (map-side) aggregates over 9 fields or a few
categories; nothing but the top-k reaches a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions.sql import js_number, js_trim, normalize_date, pct

NUMERIC_TOLERANCE = 0.01
NF = len(S.GROUND_TRUTH_FIELDS)


def ground_truth_sql(r: str = "record") -> dict[str, str]:
    """The nine scored values of a record (vendor -> ``vendor.name``)."""
    return {f: (f"{r}.vendor.name" if f == "vendor_name" else f"{r}.{f}.value")
            for f in S.GROUND_TRUTH_FIELDS}


def ground_truth(records: DataFrame, keep=("doc_id",)) -> DataFrame:
    gt = ground_truth_sql()
    return records.selectExpr(*keep, *[f"{gt[f]} AS {f}" for f in S.GROUND_TRUTH_FIELDS])


def pair_by_doc(expected: DataFrame, actual: DataFrame, key: str = "doc_id",
                keep: tuple = ()) -> DataFrame:
    """J3 for separate tables: equi left join on the document key, so a
    document without an extraction row stays, as an error. ``actual`` may
    carry an ``error`` column. Output: key, keep, error, e_<f>, a_<f>."""
    e = expected.selectExpr(key, *keep, *[f"{f} AS e_{f}" for f in S.GROUND_TRUTH_FIELDS])
    err = "error" if "error" in actual.columns else "CAST(NULL AS STRING)"
    a = actual.selectExpr(key, f"{err} AS _err", "true AS _seen",
                          *[f"{f} AS a_{f}" for f in S.GROUND_TRUTH_FIELDS])
    return e.join(a, key, "left").selectExpr(
        key, *keep, "CASE WHEN _seen IS NULL THEN 'no extraction' ELSE _err END AS error",
        *[f"e_{f}" for f in S.GROUND_TRUTH_FIELDS], *[f"a_{f}" for f in S.GROUND_TRUTH_FIELDS])


def _field_score(f: str) -> tuple[str, str, str, str]:
    """(match, note, expected text, actual text) SQL for one field."""
    e, a = f"e_{f}", f"a_{f}"
    head = f"CASE WHEN {e} IS NULL THEN true WHEN {a} IS NULL THEN false "
    if f in S.STRING_SCORED:
        match = head + f"ELSE lower({js_trim(a)}) = lower({js_trim(e)}) END"
        note = f"CASE WHEN {e} IS NOT NULL AND {a} IS NULL THEN 'actual is null' END"
        return match, note, e, a
    if f in S.DATE_SCORED:
        na, ne = f"_na_{f}", f"_ne_{f}"
        match = head + f"WHEN {na} IS NULL OR {ne} IS NULL THEN false ELSE {na} = {ne} END"
        note = (f"CASE WHEN {e} IS NULL THEN NULL WHEN {a} IS NULL THEN 'actual is null' "
                f"WHEN {na} IS NULL OR {ne} IS NULL THEN concat('unparseable date: actual=', {a}, "
                f"' expected=', {e}) END")
        return match, note, e, a
    diff = f"abs({a} - {e})"
    match = head + f"ELSE {diff} <= {NUMERIC_TOLERANCE}D END"
    note = (f"CASE WHEN {e} IS NULL THEN NULL WHEN {a} IS NULL THEN 'actual is null' "
            f"WHEN {diff} > {NUMERIC_TOLERANCE}D THEN concat('diff: ', format_string('%.4f', {diff})) END")
    return match, note, js_number(e), js_number(a)


def document_scores(pairs: DataFrame, keep=("doc_id", "category")) -> DataFrame:
    """One row per document: per field i ``m<i>`` (match), ``n<i>`` (note),
    ``x<i>``/``y<i>`` (expected/actual text), ``s<i>`` (expected present);
    ``passed`` (A6), ``n_fields``, ``n_matched``, ``n_failed`` (A11)."""
    staged = pairs.selectExpr(
        *keep, "error", *[f"e_{f}" for f in S.GROUND_TRUTH_FIELDS],
        *[f"a_{f}" for f in S.GROUND_TRUTH_FIELDS],
        *[f"{normalize_date('a_' + f)} AS _na_{f}" for f in S.DATE_SCORED],
        *[f"{normalize_date('e_' + f)} AS _ne_{f}" for f in S.DATE_SCORED])
    cols = []
    for i, f in enumerate(S.GROUND_TRUTH_FIELDS):
        m, n, x, y = _field_score(f)
        cols += [f"{m} AS m{i}", f"{n} AS n{i}", f"CAST({x} AS STRING) AS x{i}",
                 f"CAST({y} AS STRING) AS y{i}", f"e_{f} IS NOT NULL AS s{i}"]
    scored = staged.selectExpr(*keep, "error", *cols)
    matched = " + ".join(f"CAST(m{i} AS BIGINT)" for i in range(NF))
    passed = " AND ".join(["error IS NULL"] + [f"(NOT s{i} OR m{i})" for i in range(NF)])
    return scored.selectExpr(
        "*", f"{passed} AS passed",
        f"CAST(CASE WHEN error IS NULL THEN {NF} ELSE 0 END AS BIGINT) AS n_fields",
        f"CASE WHEN error IS NULL THEN {matched} ELSE 0L END AS n_matched",
        f"CASE WHEN error IS NULL THEN {NF} - ({matched}) ELSE 0L END AS n_failed")


def score_array_sql() -> str:
    """The nine score structs of a document (field order)."""
    return "array(" + ", ".join(
        f"named_struct('field_no', {i}, 'field', '{f}', 'match', m{i}, 'expected', x{i}, "
        f"'actual', y{i}, 'note', n{i})" for i, f in enumerate(S.GROUND_TRUTH_FIELDS)) + ")"


def field_scores(docs: DataFrame) -> DataFrame:
    """Long table: one row per (document, field); errored documents bring none."""
    return docs.filter("error IS NULL").selectExpr("doc_id", f"inline({score_array_sql()})")


def _field_sums() -> list:
    """One row's worth of counts: documents, scored documents, and matches per field."""
    return [F.count("*").alias("invoices"), F.count_if(F.expr("error IS NULL")).alias("scored"),
            *[F.count_if(F.expr(f"error IS NULL AND m{i}")).alias(f"k{i}") for i in range(NF)]]


def accuracy_by_field(docs: DataFrame) -> DataFrame:
    """A4: one aggregate of nine counts, then nine rows; no field rows are shuffled."""
    rows = ", ".join(f"named_struct('field_no', {i}, 'field', '{f}', 'matched', k{i}, 'total', scored)"
                     for i, f in enumerate(S.GROUND_TRUTH_FIELDS))
    return (docs.agg(*_field_sums()).where("scored > 0").selectExpr(f"inline(array({rows}))")
            .selectExpr("*", f"{pct('matched', 'total')} AS accuracy"))


def accuracy_by_category(docs: DataFrame) -> DataFrame:
    return (docs.groupBy("category")
            .agg(F.count("*").alias("invoices"), F.sum("n_matched").alias("matched"),
                 F.sum("n_fields").alias("total"))
            .selectExpr("*", f"{pct('matched', 'total')} AS accuracy"))


def accuracy_overall(docs: DataFrame) -> DataFrame:
    return (docs.agg(F.count("*").alias("invoices"), F.count_if("passed").alias("passed"),
                     F.coalesce(F.sum("n_fields"), F.lit(0)).cast("long").alias("fields"),
                     F.coalesce(F.sum("n_matched"), F.lit(0)).cast("long").alias("matched"))
            .selectExpr("*", f"{pct('passed', 'invoices')} AS pass_rate",
                        f"{pct('matched', 'fields')} AS field_accuracy"))


def accuracy_rollup(docs: DataFrame) -> DataFrame:
    """A3-A5 in one pass: counts per category (partial aggregates), from which the field, category and overall rows are
    summed. ``docs`` has one row per document."""
    total, matched = f"{NF} * scored", " + ".join(f"k{i}" for i in range(NF))
    rows = [f"named_struct('level', 'field', 'name', '{f}', 'invoices', scored, 'total', scored, 'matched', k{i})"
            for i, f in enumerate(S.GROUND_TRUTH_FIELDS)]
    rows += [f"named_struct('level', {lv}, 'name', {name}, 'invoices', invoices, 'total', {total}, 'matched', {matched})"
             for lv, name in (("'category'", "category"), ("'overall'", "'all'"))]
    return (docs.groupBy("category").agg(*_field_sums()).selectExpr(f"inline(array({', '.join(rows)}))")
            .groupBy("level", "name").agg(F.sum("invoices").alias("invoices"), F.sum("total").alias("total"),
                                          F.sum("matched").alias("matched"))
            .where("level <> 'field' OR total > 0"))


def bottom_failures(docs: DataFrame, n: int = 15) -> DataFrame:
    """Failed (not passed, no error) documents with most failed fields,
    ties in document-id order; top ``n`` only (TakeOrderedAndProject).

    Written as one top-k on a key that is -1 for documents that are not
    failures (a failure has at least one failed field), then a filter on the
    k rows: the same rows as filter-then-top-k, without pushing a predicate
    on the wide scoring expressions down through the projections."""
    keyed = docs.selectExpr("doc_id", "category",
                            "CASE WHEN passed OR error IS NOT NULL THEN -1L ELSE n_failed END AS failed_fields")
    return (keyed.orderBy(F.desc("failed_fields"), F.asc("doc_id")).limit(n)
            .filter("failed_fields >= 0"))
