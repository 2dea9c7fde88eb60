"""M5 - rendered document text, rule extraction round trip, evidence lookup,
box tags."""

from __future__ import annotations

from ledgerlens.operators import evidence as EV
from ledgerlens.operators import extraction as X
from ledgerlens.plans.oracle_base import js_num, with_base
from ledgerlens.plans.registry import oracle_of, query
from ledgerlens.sources.invoices import invoice_records


def _texts(spark, sf_dir):
    return X.render_text(invoice_records(spark, sf_dir))


def _ps(s: str, n: int) -> str:
    return f"(CASE WHEN length({s}) >= {n} THEN {s} ELSE lpad({s}, {n}, ' ') END)"


def _pe(s: str, n: int) -> str:
    return f"(CASE WHEN length({s}) >= {n} THEN {s} ELSE rpad({s}, {n}, ' ') END)"


TEXT_CTE = f""",
item_lines AS (
  SELECT k, string_agg({_pe("coalesce(description, '')", 48)} || '  ' || {_ps(js_num('quantity'), 3)} || '   ' ||
         {_ps("printf('%.2f', unit_price)", 10)} || '   ' || {_ps("printf('%.2f', quantity * unit_price)", 10)},
         chr(10) ORDER BY pos) AS lines
  FROM items GROUP BY k),
texts AS (
  SELECT inv.k, inv.doc_id, concat_ws(chr(10), 'INVOICE', coalesce(vendor_name, ''), '',
    'Invoice Number: ' || inv_no, 'Bill Date: ' || bill,
    CASE WHEN due IS NOT NULL AND due <> '' THEN 'Due Date: ' || due END,
    CASE WHEN po IS NOT NULL AND po <> '' THEN 'PO Number: ' || po END,
    'Currency: ' || currency, '', '{X.ITEM_HEADER}', il.lines, '',
    'Subtotal: ' || printf('%.2f', sub), 'Tax (8%): ' || printf('%.2f', tax),
    'Total: ' || printf('%.2f', total)) AS text
  FROM inv LEFT JOIN item_lines il ON il.k = inv.k)"""


@query("invoice_text", with_base(TEXT_CTE + "\nSELECT doc_id, text FROM texts"))
def q_invoice_text(spark, sf_dir):
    return _texts(spark, sf_dir)


def _lab(label: str) -> str:
    return f"nullif(regexp_extract(text, '(?m)^{label}: (.*)$', 1), '')"


@query("rule_extraction", with_base(TEXT_CTE + f"""
SELECT doc_id, {_lab('Invoice Number')} AS invoice_number, nullif(string_split(text, chr(10))[2], '') AS vendor_name,
  {_lab('Bill Date')} AS bill_date, {_lab('Due Date')} AS due_date, {_lab('PO Number')} AS po_number,
  {_lab('Currency')} AS currency, TRY_CAST({_lab('Subtotal')} AS DOUBLE) AS subtotal,
  TRY_CAST(nullif(regexp_extract(text, '(?m)^Tax \\([^)]*\\): (.*)$', 1), '') AS DOUBLE) AS tax,
  TRY_CAST({_lab('Total')} AS DOUBLE) AS total
FROM texts"""))
def q_rule_extraction(spark, sf_dir):
    ex = X.rule_extract_sql("text")
    return _texts(spark, sf_dir).selectExpr("doc_id", *[f"{v} AS {k}" for k, v in ex.items()])


# a user's extractor: labelled lines of a text, as columns
_LINES = {"invoice_number": "Invoice Number", "bill_date": "Bill Date", "due_date": "Due Date", "po_number": "PO Number", "currency": "Currency",
          "subtotal": "Subtotal", "tax": r"Tax \([^)]*\)", "total": "Total"}


def labelled_lines(texts):
    import pandas as pd
    out = pd.DataFrame({"doc_id": texts["doc_id"], "vendor_name": texts["text"].str.split("\n").str[1]})
    for column, label in _LINES.items():
        out[column] = texts["text"].str.extract(f"(?m)^{label}: (.*)$", expand=False)
    for column in ("subtotal", "tax", "total"):
        out[column] = pd.to_numeric(out[column], errors="coerce")
    return out.astype(object).where(out.notna() & (out != ""), None)


@query("plugged_extraction", oracle_of("rule_extraction"))
def q_plugged_extraction(spark, sf_dir):
    """A user's extractor over batches of rendered texts."""
    schema = "doc_id string, vendor_name string, " + ", ".join(f"{c} {'double' if c in ('subtotal', 'tax', 'total') else 'string'}" for c in _LINES)
    return X.extract_with(_texts(spark, sf_dir).select("doc_id", "text"), labelled_lines, schema)


@query("rule_records", with_base(TEXT_CTE + """,
it AS (SELECT k, count(*) AS n, round(sum(CAST(printf('%.2f', quantity * unit_price) AS DOUBLE)), 2) AS amount, sum(quantity) AS quantity,
              md5(string_agg(coalesce(nullif(rtrim(description), ''), '-'), '|' ORDER BY pos)) AS names FROM items GROUP BY k)
SELECT inv.doc_id, CAST(coalesce(it.n, 0) AS INTEGER) AS n_items, coalesce(it.amount, 0.0) AS amount, coalesce(it.quantity, 0.0) AS quantity,
       coalesce(it.names, md5('')) AS names, CAST(7 + CASE WHEN vendor_name IS NULL THEN 0 ELSE 1 END + CASE WHEN po IS NULL THEN 0 ELSE 1 END
         - CASE WHEN due IS NULL THEN 1 ELSE 0 END AS BIGINT) AS high, inv.total
FROM inv LEFT JOIN it ON it.k = inv.k"""))
def q_rule_records(spark, sf_dir):
    """Whole records back from the rendered texts, with confidence and line items."""
    from ledgerlens.operators.validation import confidence_counts_sql
    r = X.rule_records(_texts(spark, sf_dir))
    add = "aggregate(record.line_items, 0D, (s, x) -> s + coalesce(x.{0}, 0D))"
    return r.selectExpr("doc_id", "size(record.line_items) AS n_items", f"round({add.format('amount')}, 2) AS amount", f"{add.format('quantity')} AS quantity",
                        "md5(array_join(transform(record.line_items, x -> coalesce(x.description, '-')), '|')) AS names",
                        confidence_counts_sql()[0], "record.total.value AS total")


_MONTHS = "[" + ", ".join(f"'{m}'" for m in EV.MONTHS) + "]"


def _dates(iso: str) -> str:
    y, mm, dd = (f"regexp_extract({iso}, '^(\\d{{4}})-(\\d{{2}})-(\\d{{2}})$', {i})" for i in (1, 2, 3))
    ml = f"{_MONTHS}[CAST({mm} AS INTEGER)]"
    day = f"CAST(CAST({dd} AS INTEGER) AS VARCHAR)"
    return (f"CASE WHEN {iso} IS NULL OR {iso} = '' THEN CAST([] AS VARCHAR[]) "
            f"WHEN regexp_matches({iso}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN "
            f"list_filter([{iso}, {ml} || ' ' || {day} || ', ' || {y}, substr({ml}, 1, 3) || ' ' || {day} || ', ' || {y}, "
            f"{mm} || '/' || {dd} || '/' || {y}, {dd} || '/' || {mm} || '/' || {y}, {ml} || ' ' || {day}], "
            f"lambda v: v IS NOT NULL AND v <> '') ELSE [{iso}] END")


def _single(s: str) -> str:
    return f"CASE WHEN {s} IS NULL OR {s} = '' THEN CAST([] AS VARCHAR[]) ELSE [{s}] END"


def _money(n: str) -> str:
    return f"CASE WHEN {n} IS NULL THEN CAST([] AS VARCHAR[]) ELSE [format('{{:,.2f}}', {n}), printf('%.2f', {n})] END"


def _words(s: str) -> str:
    return (f"CASE WHEN {s} IS NULL OR {s} = '' THEN CAST([] AS VARCHAR[]) ELSE list_concat([{s}], "
            f"list_filter(regexp_split_to_array({s}, '\\s+'), lambda w: length(w) > 3)) END")


_VARIANTS = [_single("inv_no"), _words("vendor_name"), _dates("bill"), _dates("due"), _single("po"),
             _money("sub"), _money("tax"), _money("total"), _single("currency")]
EVIDENCE_SQL = TEXT_CTE + ",\nvl AS (" + "\nUNION ALL ".join(
    f"SELECT doc_id, k, {i} AS label_no, '{lb}' AS label, {v} AS vs FROM inv"
    for i, (lb, v) in enumerate(zip(EV.LABELS, _VARIANTS))) + """),
v AS (SELECT doc_id, k, label_no, label, unnest(vs) AS variant, generate_subscripts(vs, 1) - 1 AS variant_no FROM vl),
hits AS (
  SELECT v.doc_id, v.label_no, v.label, v.variant_no,
         len(string_split(substr(t.text, 1, instr(lower(t.text), lower(trim(v.variant))) - 1), chr(10))) - 1 AS line_no
  FROM v JOIN texts t ON t.k = v.k
  WHERE length(trim(v.variant)) >= 2 AND instr(lower(t.text), lower(trim(v.variant))) > 0),
best AS (SELECT doc_id, label_no, label, min(variant_no) AS variant_no FROM hits GROUP BY ALL)
SELECT b.doc_id, b.label_no, b.label, CAST(b.variant_no AS BIGINT) AS variant_no, CAST(min(h.line_no) AS BIGINT) AS line_no
FROM best b JOIN hits h ON h.doc_id = b.doc_id AND h.label_no = b.label_no AND h.variant_no = b.variant_no
GROUP BY b.doc_id, b.label_no, b.label, b.variant_no"""


@query("evidence_lookup", with_base(EVIDENCE_SQL))
def q_evidence_lookup(spark, sf_dir):
    rec = invoice_records(spark, sf_dir)
    docs = X.render_text(rec.select("doc_id", "record"), "record").selectExpr("doc_id", "text", f"{EV.labels_sql()} AS labels")
    return EV.lookup_within(docs).selectExpr(
        "doc_id", "CAST(label_no AS INT) AS label_no", "label", "variant_no", "line_no")


# stand-in for a page: a rendered line's parts (two spaces or more apart) are its items, placed line by line, some slanted
PAGE = "named_struct('width', 918D, 'height', 1188D, 'scale', 1.5D, 'transform', array(1.5D, 0D, 0D, -1.5D, 0D, 1188D))"


def positioned(spark, sf_dir):
    rec = invoice_records(spark, sf_dir)
    docs = X.render_text(rec.select("doc_id", "record"), "record").selectExpr(
        "doc_id", f"{EV.labels_sql()} AS labels",
        "flatten(transform(split(text, '\\n', -1), (l, i) -> transform(split(l, ' {2,}', -1), (p, j) -> named_struct('str', p, 'l', i, 'p', j)))) AS parts")
    return docs.selectExpr(
        "doc_id", "labels", f"{PAGE} AS page",
        "transform(parts, (x, n) -> named_struct('str', x.str, 'width', 6D * char_length(x.str), 'height', 8D + n % 4, 'transform', "
        "array(10D, 0D, CAST(n % 3 AS DOUBLE), 10D + n % 4, 40D + x.p * 150D, 760D - 14D * x.l))) AS items")


@query("evidence_boxes", with_base(EVIDENCE_SQL.split("\nhits AS (")[0] + """
pl AS (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM texts),
pp AS (SELECT k, l, unnest(regexp_split_to_array(line, ' {2,}')) AS str, generate_subscripts(regexp_split_to_array(line, ' {2,}'), 1) - 1 AS p FROM pl),
it AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l, p) - 1 AS n FROM pp),
hits AS (SELECT v.doc_id, v.k, v.label_no, v.label, v.variant_no, it.n FROM v JOIN it ON it.k = v.k
         WHERE length(trim(v.variant)) >= 2 AND contains(lower(it.str), lower(trim(v.variant)))),
best AS (SELECT doc_id, k, label_no, label, min(variant_no * 1000000 + n) AS code FROM hits GROUP BY ALL),
b AS (SELECT best.*, code // 1000000 AS variant_no, it.n, it.str, it.l, it.p FROM best JOIN it ON it.k = best.k AND it.n = code % 1000000),
t AS (SELECT *, 1.5 * (n % 3) AS t2, -1.5 * (10 + n % 4) AS t3, 1.5 * (40 + p * 150) AS t4, -1.5 * (760 - 14 * l) + 1188 AS t5 FROM b),
h AS (SELECT *, greatest((8 + n % 4) * 1.5::DOUBLE, sqrt(CAST(t2 AS DOUBLE) * t2 + CAST(t3 AS DOUBLE) * t3)) AS hh, greatest(6.0::DOUBLE * length(str) * 1.5, 4.0) AS ww FROM t)
SELECT doc_id, label_no, label, CAST(variant_no AS INTEGER) AS variant_no, CAST(n AS INTEGER) AS item_no,
       round(greatest(0.0, t4 / 918.0::DOUBLE), 9) AS x, round(greatest(0.0, (t5 - hh) / 1188.0::DOUBLE), 9) AS y,
       round(least(1.0, ww / 918.0::DOUBLE), 9) AS w, round(least(1.0, hh / 1188.0::DOUBLE), 9) AS h FROM h"""))
def q_evidence_boxes(spark, sf_dir):
    """J6 + F9 over positioned items: where on the page each value stands."""
    return EV.evidence_boxes(positioned(spark, sf_dir)).selectExpr(
        "doc_id", "label_no", "label", "variant_no", "item_no", *[f"round({c}, 9) AS {c}" for c in "xywh"])


_BBOX = r"^\[bbox:\s*([-\d.]+)\s*,\s*([-\d.]+)\s*,\s*([-\d.]+)\s*,\s*([-\d.]+)\s*\]\s*"
_NONE = r"(?i)^\[bbox:\s*none\s*\]\s*"


def _bpart(i: int) -> str:
    return (f"TRY_CAST(nullif(regexp_extract(regexp_extract(rsn, '{_BBOX}', {i}), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)', 0), '') "
            f"AS DOUBLE)")


_OK = " AND ".join(f"({_bpart(i)} IS NOT NULL AND {_bpart(i)} >= -0.1 AND {_bpart(i)} <= 1.1)" for i in range(1, 5))
BOX_SQL = ",\nr AS (" + "\nUNION ALL ".join(f"SELECT doc_id, {i} AS field_no, rsn{i} AS rsn FROM inv" for i in range(9)) + ")\n" + \
    "SELECT doc_id, field_no, " + ", ".join(
        f"CASE WHEN NOT regexp_matches(rsn, '{_NONE}') AND regexp_matches(rsn, '{_BBOX}') AND {_OK} THEN {_bpart(i)} END AS {n}"
        for i, n in zip(range(1, 5), "xywh")) + \
    f", CASE WHEN regexp_matches(rsn, '{_NONE}') THEN regexp_replace(rsn, '{_NONE}', '') " \
    f"WHEN regexp_matches(rsn, '{_BBOX}') THEN regexp_replace(rsn, '{_BBOX}', '') ELSE rsn END AS text FROM r"


@query("box_tags", with_base(BOX_SQL))
def q_box_tags(spark, sf_dir):
    rec = invoice_records(spark, sf_dir)
    fields = ("invoice_number", "vendor", "bill_date", "due_date", "po_number", "subtotal", "tax",
              "total", "currency")
    arr = "array(" + ", ".join(f"record.{f}.reasoning" for f in fields) + ")"
    return X.with_boxes(rec.selectExpr("doc_id", f"posexplode({arr}) AS (field_no, rsn)"), "rsn").drop("rsn")
