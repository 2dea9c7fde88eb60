"""Deterministic cross-field checks (P3, V1-V6), line sum (A1), confidence
counts (A2) and flag merging (U1s). All are per-record projections: no
shuffle, no Python.

Rule order is the flag order: V1 math, V2 line sum, V3 non-positive total,
V4 due before bill, V5 bill in the future, V6 vendor missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions.sql import fixed2, lit, parsed_date, round2

MONEY_TOLERANCE = 0.02
RULES = ("V1", "V2", "V3", "V4", "V5", "V6")


def line_sum_sql(r: str = "record") -> str:
    """A1: sum of item amounts in item order, a null amount counting 0."""
    return f"aggregate({r}.line_items, 0D, (acc, x) -> acc + coalesce(x.amount, 0D))"


def _staged(records: DataFrame, r: str = "record") -> DataFrame:
    """Adds the dates, the line sum and the computed total that several rules look at, each read once."""
    line_sum = f"{r}.line_items IS NOT NULL AND {r}.subtotal.value IS NOT NULL"
    return records.selectExpr(
        "*", *[f"CASE WHEN coalesce({r}.{f}_date.value, '') <> '' THEN {parsed_date(f'{r}.{f}_date.value')} END AS _{f}_d" for f in ("bill", "due")],
        f"CASE WHEN {line_sum} THEN {round2(line_sum_sql(r))} END AS _line_sum", f"{round2(f'{r}.subtotal.value + {r}.tax.value')} AS _computed")


def rule_flags_sql(as_of: str, r: str = "record", with_rule: bool = False, staged: bool = False) -> str:
    """Array of the flags the rules raise, in rule order; ``staged``: over the columns of ``_staged``."""
    sub, tax, tot = f"{r}.subtotal.value", f"{r}.tax.value", f"{r}.total.value"
    bill, due = f"{r}.bill_date.value", f"{r}.due_date.value"
    bill_d, due_d = ("_bill_d", "_due_d") if staged else (parsed_date(bill), parsed_date(due))
    computed = "_computed" if staged else round2(f"{sub} + {tax}")
    line_sum = "_line_sum" if staged else round2(line_sum_sql(r))

    def flag(rule: str, sev: str, msg: str) -> str:
        head = f"'rule', '{rule}', " if with_rule else ""
        return f"named_struct({head}'severity', '{sev}', 'message', {msg})"
    checks = [
        (f"{sub} IS NOT NULL AND {tax} IS NOT NULL AND {tot} IS NOT NULL "
         f"AND abs({computed} - {tot}) > {MONEY_TOLERANCE}D",
         flag("V1", "error", f"concat('Math doesn\\'t add up: subtotal ($', {fixed2(sub)}, ') + tax ($', "
                             f"{fixed2(tax)}, ') = $', {fixed2(computed)}, ', but total is $', {fixed2(tot)}, '.')")),
        (f"size({r}.line_items) > 0 AND {sub} IS NOT NULL AND abs({line_sum} - {sub}) > {MONEY_TOLERANCE}D",
         flag("V2", "warning", f"concat('Line items sum to $', {fixed2(line_sum)}, ', but subtotal is $', "
                               f"{fixed2(sub)}, '.')")),
        (f"{tot} IS NOT NULL AND {tot} <= 0",
         flag("V3", "warning", f"concat('Total is $', {fixed2(tot)}, ', expected a positive value.')")),
        (f"coalesce({bill}, '') <> '' AND coalesce({due}, '') <> '' AND {bill_d} IS NOT NULL "
         f"AND {due_d} IS NOT NULL AND {due_d} < {bill_d}",
         flag("V4", "error", f"concat('Due date (', {due}, ') is before bill date (', {bill}, ').')")),
        (f"coalesce({bill}, '') <> '' AND {bill_d} IS NOT NULL AND {bill_d} > DATE {lit(as_of)}",
         flag("V5", "warning", f"concat('Bill date (', {bill}, ') is in the future.')")),
        (f"coalesce({r}.vendor.name, '') = ''",
         flag("V6", "warning", "'Vendor name could not be extracted.'")),
    ]
    arr = ", ".join(f"CASE WHEN {c} THEN {f} END" for c, f in checks)
    return f"filter(array({arr}), f -> f IS NOT NULL)"


def merge_flags_sql(model: str, det: str) -> str:
    """U1s: deterministic first, then model; first of each severity:message
    wins, order kept. Both arrays are ARRAY<STRUCT<severity, message>>."""
    return f"array_distinct(concat({det}, {model}))"


def confidence_counts_sql(r: str = "record") -> list[str]:
    """A2: high/medium/low over exactly the nine header fields."""
    out = []
    for level in S.CONFIDENCES:
        terms = " + ".join(f"CASE WHEN {r}.{f}.confidence = '{level}' THEN 1L ELSE 0L END"
                           for f in S.CONFIDENCE_FIELDS)
        out.append(f"({terms}) AS {level}")
    return out


def with_rule_flags(records: DataFrame, as_of: str) -> DataFrame:
    """Adds ``det_flags`` (with rule ids) and ``merged_flags`` to records."""
    det = "transform(det_flags, f -> named_struct('severity', f.severity, 'message', f.message))"
    return (_staged(records).selectExpr(*_names(records), f"{rule_flags_sql(as_of, with_rule=True, staged=True)} AS det_flags")
            .selectExpr("*", f"{merge_flags_sql('record.flags', det)} AS merged_flags"))


def _names(records: DataFrame) -> list[str]:
    return [f"`{c}`" for c in records.columns]


def validated(records: DataFrame, as_of: str) -> DataFrame:
    """Records with the merged flag list written back into the record, as
    the extraction route returns them."""
    det = rule_flags_sql(as_of, staged=True)
    return _staged(records).withColumn(
        "record", F.col("record").withField("flags", F.expr(merge_flags_sql("record.flags", det)))).select(*_names(records))
