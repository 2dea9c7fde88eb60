"""Document text rendering (P16, P17), rule-based field extraction (P15,
the default of the pluggable extractor U1), box-tag parsing (P8).

Rendering and rule extraction are per-row SQL expressions. ``extract_with``
runs any user extractor (e.g. a model client) over Arrow batches with
``mapInPandas`` - the pluggable slow path, filtered before it by hand since
predicates do not cross a Python operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ledgerlens import schemas as S
from ledgerlens.functions.sql import fixed2, js_number

# The item table header of the rendered documents.
ITEM_HEADER = "Description                                        Qty   Unit Price   Amount"


def pad_start(s: str, n: int) -> str:
    """JS ``padStart`` (Spark ``lpad`` would cut longer text)."""
    return f"(CASE WHEN char_length({s}) >= {n} THEN {s} ELSE lpad({s}, {n}, ' ') END)"


def pad_end(s: str, n: int) -> str:
    return f"(CASE WHEN char_length({s}) >= {n} THEN {s} ELSE rpad({s}, {n}, ' ') END)"


def item_lines_sql(items: str) -> str:
    """The lines of the item table: each cell's text is made once, then padded."""
    cells = (f"transform({items}, x -> named_struct('d', coalesce(x.description, ''), 'q', {js_number('x.quantity')}, "
             f"'p', {fixed2('x.unit_price')}, 'a', {fixed2('x.quantity * x.unit_price')}))")
    return (f"transform({cells}, x -> concat({pad_end('x.d', 48)}, '  ', {pad_start('x.q', 3)}, '   ', "
            f"{pad_start('x.p', 10)}, '   ', {pad_start('x.a', 10)}))")


def render_lines_sql(r: str = "record", tax_pct: str = "8") -> str:
    """The document lines of a record, as an array (label lines, item
    table, totals)."""
    opt = lambda label, v: f"CASE WHEN {v} IS NOT NULL AND {v} <> '' THEN concat('{label}: ', {v}) END"
    head = (f"array('INVOICE', coalesce({r}.vendor.name, ''), '', "
            f"concat('Invoice Number: ', coalesce({r}.invoice_number.value, '')), "
            f"concat('Bill Date: ', coalesce({r}.bill_date.value, '')), "
            f"{opt('Due Date', f'{r}.due_date.value')}, {opt('PO Number', f'{r}.po_number.value')}, "
            f"concat('Currency: ', coalesce({r}.currency.value, '')), '', '{ITEM_HEADER}')")
    items = item_lines_sql(f"{r}.line_items")
    tail = (f"array('', concat('Subtotal: ', {fixed2(f'{r}.subtotal.value')}), "
            f"concat('Tax ({tax_pct}%): ', {fixed2(f'{r}.tax.value')}), "
            f"concat('Total: ', {fixed2(f'{r}.total.value')}))")
    return f"filter(concat({head}, {items}, {tail}), l -> l IS NOT NULL)"


def render_text(records: DataFrame, *keep: str) -> DataFrame:
    """doc_id, kept columns, text (lines joined with LF)."""
    return records.selectExpr("doc_id", *keep, f"array_join({render_lines_sql()}, '\\n') AS text")


def _label(text: str, label: str) -> str:
    return f"nullif(regexp_extract({text}, '(?m)^{label}: (.*)$', 1), '')"


def rule_extract_sql(text: str = "text") -> dict[str, str]:
    """P15, header values: labelled lines -> values, null where there is no such line."""
    num = lambda label: f"try_cast({_label(text, label)} AS DOUBLE)"
    return {
        "invoice_number": _label(text, "Invoice Number"),
        "vendor_name": f"nullif(split({text}, '\\n')[1], '')",
        "bill_date": _label(text, "Bill Date"),
        "due_date": _label(text, "Due Date"),
        "po_number": _label(text, "PO Number"),
        "currency": _label(text, "Currency"),
        "subtotal": num("Subtotal"),
        "tax": f"try_cast(nullif(regexp_extract({text}, '(?m)^Tax \\\\([^)]*\\\\): (.*)$', 1), '') AS DOUBLE)",
        "total": num("Total"),
    }


_LABELS = {"invoice_number": "Invoice Number", "bill_date": "Bill Date", "due_date": "Due Date", "po_number": "PO Number",
           "subtotal": "Subtotal", "tax": "Tax", "total": "Total", "currency": "Currency"}
ITEM_RE = r"^(.*?) {2,}(\\S+) {3,}(\\S+) {3,}(\\S+)$"


def rule_records(texts: DataFrame, text: str = "text") -> DataFrame:
    """Full records (``schemas.RECORD``) from rendered texts. A value from its labelled line has confidence ``high`` and
    names the line; a missing one is null with confidence ``low``. Items come from the lines between the table header and the next
    empty line; no flags are raised here. One row per input row; input columns are kept."""
    cols = texts.columns
    ex = rule_extract_sql(text)
    lines = f"split({text}, '\\n')"
    staged = texts.selectExpr("*", *[f"{v} AS _{k}" for k, v in ex.items()], f"{lines} AS _lines")
    staged = staged.selectExpr("*", f"array_position(_lines, '{ITEM_HEADER}') AS _head")
    staged = staged.selectExpr("*", "CASE WHEN _head > 0 THEN slice(_lines, CAST(_head AS INT) + 1, size(_lines)) ELSE CAST(array() AS ARRAY<STRING>) END AS _rest")
    staged = staged.selectExpr("*", "slice(_rest, 1, greatest(CAST(array_position(_rest, '') AS INT) - 1, 0)) AS _items")

    def field(f: str, where: str) -> str:
        return (f"named_struct('value', _{f}, 'confidence', CASE WHEN _{f} IS NULL THEN 'low' ELSE 'high' END, "
                f"'reasoning', CASE WHEN _{f} IS NULL THEN 'No such line.' ELSE '{where}' END)")
    vendor = ("named_struct('name', _vendor_name, 'address', CAST(NULL AS STRING), 'confidence', CASE WHEN _vendor_name IS NULL THEN 'low' ELSE 'high' END, "
              "'reasoning', CASE WHEN _vendor_name IS NULL THEN 'No such line.' ELSE 'Line under the title.' END)")
    part = lambda i: f"regexp_extract(x, '{ITEM_RE}', {i})"
    items = (f"transform(filter(_items, x -> x RLIKE '{ITEM_RE}'), x -> named_struct('description', nullif(rtrim({part(1)}), ''), "
             f"'quantity', try_cast({part(2)} AS DOUBLE), 'unit_price', try_cast({part(3)} AS DOUBLE), 'amount', try_cast({part(4)} AS DOUBLE), "
             "'reasoning', 'Row of the item table.'))")
    head = {f: field(f, f"Line labelled {_LABELS[f]}.") for f in _LABELS} | {"vendor": vendor, "line_items": items,
                                                                          "flags": "CAST(array() AS ARRAY<STRUCT<severity: STRING, message: STRING>>)"}
    return staged.selectExpr(*cols, "named_struct(" + ", ".join(f"'{f.name}', {head[f.name]}" for f in S.RECORD.fields) + ") AS record")


BBOX_RE = (r"^\\[bbox:\\s*([-\\d.]+)\\s*,\\s*([-\\d.]+)\\s*,\\s*([-\\d.]+)\\s*,\\s*([-\\d.]+)\\s*\\]\\s*")
BBOX_NONE_RE = r"(?i)^\\[bbox:\\s*none\\s*\\]\\s*"
NUM_PREFIX = r"^[+-]?(\\d+\\.?\\d*|\\.\\d+)"


def bbox_sql(reasoning: str) -> dict[str, str]:
    """``[bbox: x, y, w, h] `` prefix -> four doubles + stripped text;
    ``[bbox: none]`` (any case) -> null box + stripped text; a box with a
    non-number or a value outside [-0.1, 1.1] is null (text still
    stripped)."""
    def part(i):
        return (f"try_cast(nullif(regexp_extract(regexp_extract({reasoning}, '{BBOX_RE}', {i}), "
                f"'{NUM_PREFIX}', 0), '') AS DOUBLE)")
    is_none = f"{reasoning} RLIKE '{BBOX_NONE_RE}'"
    is_box = f"{reasoning} RLIKE '{BBOX_RE}'"
    vals = [part(i) for i in range(1, 5)]
    ok = " AND ".join(f"({v} IS NOT NULL AND {v} >= -0.1D AND {v} <= 1.1D)" for v in vals)
    out = {n: f"CASE WHEN NOT ({is_none}) AND {is_box} AND {ok} THEN {v} END"
           for n, v in zip(("x", "y", "w", "h"), vals)}
    out["text"] = (f"CASE WHEN {is_none} THEN regexp_replace({reasoning}, '{BBOX_NONE_RE}', '') "
                   f"WHEN {is_box} THEN regexp_replace({reasoning}, '{BBOX_RE}', '') ELSE {reasoning} END")
    return out


def with_boxes(df: DataFrame, reasoning: str) -> DataFrame:
    """P8 as columns ``x, y, w, h, text`` (see ``bbox_sql``): each tag is matched once and each number read once."""
    number = f"p -> try_cast(nullif(regexp_extract(trim(p), '{NUM_PREFIX}', 0), '') AS DOUBLE)"
    staged = df.selectExpr(
        "*", f"{reasoning} RLIKE '{BBOX_NONE_RE}' AS _none", f"nullif(regexp_extract({reasoning}, '{BBOX_RE}', 0), '') AS _tag").selectExpr(
        "*", f"CASE WHEN NOT _none AND _tag IS NOT NULL THEN transform(split(substring_index(substring_index(_tag, ']', 1), ':', -1), ','), {number}) END AS _box"
    ).selectExpr("*", "coalesce(forall(_box, v -> v IS NOT NULL AND v >= -0.1D AND v <= 1.1D), false) AS _ok")
    return staged.selectExpr(
        *[f"`{c}`" for c in df.columns], *[f"CASE WHEN _ok THEN _box[{i}] END AS {n}" for i, n in enumerate(("x", "y", "w", "h"))],
        f"CASE WHEN _none THEN regexp_replace({reasoning}, '{BBOX_NONE_RE}', '') WHEN _tag IS NOT NULL THEN substr({reasoning}, char_length(_tag) + 1) "
        f"ELSE {reasoning} END AS text")


def extract_with(docs: DataFrame, extractor: Callable[[pd.DataFrame], pd.DataFrame],
                 schema: str) -> DataFrame:
    """Run a user extractor (text rows -> record rows) over Arrow
    batches. The extractor gets a pandas frame of the input columns and
    returns one of ``schema``."""
    def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield extractor(pdf)
    return docs.mapInPandas(fn, schema)
