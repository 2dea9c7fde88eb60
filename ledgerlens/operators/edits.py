"""User edits over extracted records: coercion (P9), overlay with last edit
winning per field (J4), edited marker (P10), model-only flags (J7) and the
re-validated flag list (U2s).

Edits are a long table ``(doc_id, field, raw, ts, seq)``. The overlay is one
aggregate per document (partial, so a document with many edits is combined
map-side) and one equi join on the document key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.sql import js_trim
from ledgerlens.operators.validation import merge_flags_sql, rule_flags_sql

# Editable header fields: record path of the value and kind of editor.
EDITABLE = {
    "invoice_number": ("invoice_number.value", "text"),
    "vendor_name": ("vendor.name", "text"),
    "bill_date": ("bill_date.value", "text"),
    "due_date": ("due_date.value", "text"),
    "po_number": ("po_number.value", "text"),
    "subtotal": ("subtotal.value", "money"),
    "tax": ("tax.value", "money"),
    "total": ("total.value", "money"),
    "currency": ("currency.value", "text"),
}

NUM_PREFIX = r"^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?"
MAX_DOUBLE = "1.7976931348623157E308D"


def coerce_sql(raw: str = "raw", field: str = "field") -> dict[str, str]:
    """Trimmed; empty -> null; money: commas removed, numeric prefix
    parsed (``parseFloat``), edit ignored when not finite; text as is."""
    t = js_trim(raw)
    parsed = (f"try_cast(nullif(regexp_extract(replace({t}, ',', ''), '{NUM_PREFIX}', 0), '') "
              f"AS DOUBLE)")
    money = " OR ".join(f"{field} = '{f}'" for f, (_, k) in EDITABLE.items() if k == "money")
    return {
        "is_money": f"({money})",
        "num": f"CASE WHEN {t} = '' THEN CAST(NULL AS DOUBLE) ELSE {parsed} END",
        "text": f"nullif({t}, '')",
        "valid": (f"(NOT ({money}) OR {t} = '' OR ({parsed} IS NOT NULL AND "
                  f"abs({parsed}) <= {MAX_DOUBLE}))"),
    }


def latest_edits(edits: DataFrame) -> DataFrame:
    """J4 (first half): per document, for each field, whether it was edited
    and the value of the last valid edit (by ts, then seq)."""
    c = coerce_sql()
    valid = edits.selectExpr("doc_id", "field", "ts", "seq", f"{c['valid']} AS valid",
                             f"{c['num']} AS num", f"{c['text']} AS text").filter("valid")
    aggs = []
    for f, (_, kind) in EDITABLE.items():
        val = "num" if kind == "money" else "text"
        aggs.append(F.expr(f"max(field = '{f}')").alias(f"has_{f}"))
        aggs.append(F.expr(f"max_by({val}, CASE WHEN field = '{f}' THEN struct(ts, seq) END)")
                    .alias(f"new_{f}"))
    return valid.groupBy("doc_id").agg(*aggs)


def apply_edits(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Overlay the last edits on the records; keeps ``original`` and adds
    ``edited_fields`` (P10: values that differ from the original). Documents
    without edits stay as they are; a field edited to empty is null."""
    return overlay(records.join(latest_edits(edits), "doc_id", "left"))


def overlay(j: DataFrame) -> DataFrame:
    """The overlay over records that stand beside their last edits (the columns of ``latest_edits``)."""
    rec = F.col("record")
    for f, (path, _) in EDITABLE.items():
        rec = rec.withField(path, F.expr(f"CASE WHEN coalesce(has_{f}, false) THEN new_{f} "
                                         f"ELSE record.{path} END"))
    marker = " + ".join(f"CASE WHEN NOT (edited.{p} <=> original.{p}) THEN 1 ELSE 0 END"
                        for p, _ in EDITABLE.values())
    return (j.select("*", F.col("record").alias("original"), rec.alias("edited"))
            .drop("record", *[f"{x}_{f}" for f in EDITABLE for x in ("has", "new")])
            .selectExpr("*", f"({marker}) AS edited_fields"))


def edited_markers(edited: DataFrame) -> DataFrame:
    """P10: one row per document and header field: whether the shown value
    differs from the original, with both values as text."""
    rows = ", ".join(f"named_struct('field', '{f}', 'original', CAST(original.{p} AS STRING), "
                     f"'shown', CAST(edited.{p} AS STRING), 'edited', NOT (edited.{p} <=> original.{p}))"
                     for f, (p, _) in EDITABLE.items())
    return edited.selectExpr("doc_id", f"inline(array({rows}))")


def with_display_flags(edited: DataFrame, as_of: str) -> DataFrame:
    """J7 + U2s, as column ``flags``: flags stored with the extraction (rule
    flags of the original merged with the model's) minus the original rule
    flags, merged after the rule flags of the edited record. Each rule array
    is built once, in a projection of its own; a document whose values are unchanged has the stored flags, and no second array."""
    stored = merge_flags_sql("original.flags", "_det")
    return (edited.selectExpr("*", f"{rule_flags_sql(as_of, 'original')} AS _det",
                              f"CASE WHEN edited_fields > 0 THEN {rule_flags_sql(as_of, 'edited')} END AS _now")
            .selectExpr("*", f"{stored} AS _stored").selectExpr("*", "CASE WHEN _now IS NOT NULL THEN array_except(_stored, _det) END AS _model")
            .selectExpr("*", f"CASE WHEN _now IS NULL THEN _stored ELSE {merge_flags_sql('_model', '_now')} END AS flags")
            .drop("_det", "_now", "_model", "_stored"))
