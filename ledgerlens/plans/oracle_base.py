"""DuckDB SQL for the oracle side: the invoice view of
``ledgerlens.sources.invoices`` written as flat relations.

``WITH`` + ``BASE_CTES`` defines:
  items(k, pos, ln, description, quantity, unit_price, amount)
  inv(k, doc_id, category, inv_no, vendor_name, vendor_address, bill, due, po,
      sub, tax, total, currency, n_items, conf0..conf8, rsn0..rsn8)
  mflags(k, pos, severity, message)      -- model flags
  ex(k, doc_id, category, error, a_<field>..., e_<field>...)   -- scoring pairs
"""

from __future__ import annotations


def _conf(i: int) -> str:
    return f"CASE (k + {i}) % 5 WHEN 2 THEN 'medium' WHEN 4 THEN 'low' ELSE 'high' END"


def _two(expr: str) -> str:
    return f"'0.' || lpad(CAST({expr} AS VARCHAR), 2, '0')"


def _box(i: int) -> str:
    y = _two(f"(k + 7 * {i}) % 90")
    return (f"CASE (k + {i}) % 7 WHEN 0 THEN '[bbox: ' || {_two('k % 90')} || ', ' || {y} || ', 0.25, 0.04] '"
            f" WHEN 1 THEN '[bbox: none] ' WHEN 2 THEN '[BBOX: None]  '"
            f" WHEN 3 THEN '[bbox: 1.5, ' || {y} || ', 0.1, 0.1] ' ELSE '' END")


def _rsn(i: int, label: str, shown: str) -> str:
    return f"{_box(i)} || '{label}: ' || coalesce({shown}, 'not shown')"


R2 = "floor(({x}) * 100 + 0.5) / 100"

BASE_CTES = f"""
li AS (
  SELECT l.l_orderkey AS k, l.l_linenumber AS ln, l.l_partkey AS pk, l.l_extendedprice AS px,
         l.l_discount AS dc, l.l_quantity AS quantity,
         CASE WHEN (l.l_orderkey + l.l_linenumber) % 29 = 0 THEN NULL
              WHEN (l.l_orderkey + l.l_linenumber) % 10 = 0 THEN p.p_name || ', "bulk"'
              WHEN (l.l_orderkey + l.l_linenumber) % 10 = 5 THEN ' ' || p.p_name
              ELSE p.p_name END AS description,
         floor(l.l_extendedprice * (1 - l.l_discount) * 100 + 0.5) / 100 AS amount
  FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey
),
items AS (
  SELECT k, ln, description, quantity, amount,
         floor(CASE WHEN quantity = 0 THEN NULL ELSE amount / quantity END * 100 + 0.5) / 100 AS unit_price,
         row_number() OVER (PARTITION BY k ORDER BY ln, pk, px, dc, quantity, description) - 1 AS pos
  FROM li
),
sums AS (
  SELECT k, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS item_sum, count(*) AS n_items
  FROM li GROUP BY k
),
inv0 AS (
  SELECT o.o_orderkey AS k,
         'INV-' || CAST(o.o_orderkey AS VARCHAR) AS doc_id,
         coalesce(c.c_mktsegment, 'UNKNOWN') AS category,
         'INV-' || CAST(o.o_orderkey AS VARCHAR) AS inv_no,
         CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE c.c_name END AS vendor_name,
         coalesce(c.c_mktsegment, 'UNKNOWN') || ' Plaza, Suite ' || CAST(o.o_orderkey % 100 AS VARCHAR) AS vendor_address,
         strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d') AS bill,
         CASE WHEN o.o_orderkey % 19 = 0 THEN NULL
              WHEN o.o_orderkey % 17 = 0 THEN strftime(CAST(o.o_orderdate AS DATE) - 5, '%Y-%m-%d')
              ELSE strftime(CAST(o.o_orderdate AS DATE) + 30, '%Y-%m-%d') END AS due,
         CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE 'PO-' || CAST(o.o_orderkey AS VARCHAR) END AS po,
         coalesce(s.item_sum, 0.0::DOUBLE)
           + CASE WHEN o.o_orderkey % 13 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS sub,
         coalesce(s.n_items, 0) AS n_items
  FROM orders o
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN sums s ON s.k = o.o_orderkey
),
inv1 AS (
  SELECT *, floor(sub * 0.08::DOUBLE * 100 + 0.5) / 100 AS tax FROM inv0
),
inv2 AS (
  SELECT *, CASE WHEN k % 97 = 0 THEN 0.0::DOUBLE
                 ELSE floor((sub + tax) * 100 + 0.5) / 100
                      + CASE WHEN k % 11 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS total,
         'USD' AS currency
  FROM inv1
),
inv AS (
  SELECT *,
    {_conf(0)} AS conf0, {_conf(1)} AS conf1, {_conf(2)} AS conf2, {_conf(3)} AS conf3,
    {_conf(4)} AS conf4, {_conf(5)} AS conf5, {_conf(6)} AS conf6, {_conf(7)} AS conf7,
    {_conf(8)} AS conf8,
    {_rsn(0, 'Invoice Number', 'inv_no')} AS rsn0,
    {_rsn(1, 'Vendor', 'vendor_name')} AS rsn1,
    {_rsn(2, 'Bill Date', 'bill')} AS rsn2,
    {_rsn(3, 'Due Date', 'due')} AS rsn3,
    {_rsn(4, 'PO Number', 'po')} AS rsn4,
    {_rsn(5, 'Subtotal', "printf('%.2f', sub)")} AS rsn5,
    {_rsn(6, 'Tax', "printf('%.2f', tax)")} AS rsn6,
    {_rsn(7, 'Total', "printf('%.2f', total)")} AS rsn7,
    {_rsn(8, 'Currency', "'USD'")} AS rsn8
  FROM inv2
),
mflags0 AS (
  SELECT k, 0 AS slot, 'warning' AS severity, 'Vendor name could not be extracted.' AS message
    FROM inv WHERE k % 23 = 0 AND k % 2 = 0
  UNION ALL SELECT k, 1, 'info', 'Currency could not be determined.' FROM inv WHERE k % 31 = 0
  UNION ALL SELECT k, 2, 'warning', 'Possible duplicate invoice.' FROM inv WHERE k % 37 = 0
  UNION ALL SELECT k, 3, 'warning', 'Possible duplicate invoice.' FROM inv WHERE k % 37 = 0
),
mflags AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS pos, severity, message FROM mflags0
),
ex AS (
  SELECT k, doc_id, category,
    CASE WHEN k % 101 = 0 THEN 'Extraction failed: model-API-failure' END AS error,
    inv_no AS e_invoice_number, vendor_name AS e_vendor_name, bill AS e_bill_date, due AS e_due_date,
    po AS e_po_number, sub AS e_subtotal, tax AS e_tax, total AS e_total, currency AS e_currency,
    CASE WHEN k % 43 = 0 THEN inv_no || 'X' WHEN k % 41 = 0 THEN ' ' || inv_no || ' '
         WHEN k % 7 = 0 THEN lower(inv_no) ELSE inv_no END AS a_invoice_number,
    CASE WHEN k % 47 = 0 THEN NULL WHEN k % 11 = 0 THEN upper(vendor_name) ELSE vendor_name END AS a_vendor_name,
    CASE WHEN k % 53 = 0 THEN 'not a date'
         WHEN k % 13 = 0 THEN strftime(CAST(bill AS DATE), '%B %-d, %Y')
         WHEN k % 5 = 0 THEN strftime(CAST(bill AS DATE), '%-d-%b-%Y')
         WHEN k % 3 = 0 THEN strftime(CAST(bill AS DATE), '%-m/%-d/%Y') ELSE bill END AS a_bill_date,
    CASE WHEN k % 59 = 0 THEN NULL
         WHEN k % 6 = 0 THEN strftime(CAST(due AS DATE) + 1, '%Y-%m-%d') ELSE due END AS a_due_date,
    CASE WHEN k % 9 = 0 THEN NULL ELSE po END AS a_po_number,
    CASE WHEN k % 29 = 0 THEN sub + 0.02::DOUBLE WHEN k % 8 = 0 THEN sub + 0.005::DOUBLE ELSE sub END AS a_subtotal,
    CASE WHEN k % 61 = 0 THEN NULL ELSE tax END AS a_tax,
    CASE WHEN k % 31 = 0 THEN NULL WHEN k % 67 = 0 THEN total + 0.5::DOUBLE ELSE total END AS a_total,
    CASE WHEN k % 17 = 0 THEN 'usd' WHEN k % 71 = 0 THEN 'EUR' ELSE currency END AS a_currency
  FROM inv
)"""


def with_base(sql: str) -> str:
    """Prefix a query that may start with more CTEs (``, name AS (...)``) or
    directly with ``SELECT``."""
    body = sql.strip()
    if body.upper().startswith("SELECT"):
        return "WITH " + BASE_CTES + "\n" + body
    return "WITH " + BASE_CTES + body


def js_num(x: str) -> str:
    """``String(n)`` for doubles in DuckDB (shortest digits, no ``.0``)."""
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def round2(x: str) -> str:
    return R2.format(x=x)


def pct(n: str, d: str) -> str:
    t = f"((2 * CAST({n} AS BIGINT) * 1000 + CAST({d} AS BIGINT)) // (2 * CAST({d} AS BIGINT)))"
    return (f"CASE WHEN {d} = 0 THEN 'n/a' ELSE CAST({t} // 10 AS VARCHAR) || '.' || "
            f"CAST({t} % 10 AS VARCHAR) || '%' END")


def jtrim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def normalize_date(x: str) -> str:
    """F2 in DuckDB (month number by position in a fixed list)."""
    short = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    long_ = ("['january','february','march','april','may','june','july','august',"
             "'september','october','november','december']")
    mdy = r"'^(\d{1,2})/(\d{1,2})/(\d{4})$'"
    dmy = r"'^(\d{1,2})-([A-Za-z]{3})-(\d{4})$'"
    lng = r"'^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$'"
    sm = f"list_position({short}, lower(regexp_extract({x}, {dmy}, 2)))"
    lm = f"list_position({long_}, lower(regexp_extract({x}, {lng}, 1)))"
    return f"""(CASE WHEN {x} IS NULL OR {x} = '' THEN NULL
      WHEN regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {x}
      WHEN regexp_matches({x}, {mdy}) THEN regexp_extract({x}, {mdy}, 3) || '-' ||
           lpad(regexp_extract({x}, {mdy}, 1), 2, '0') || '-' || lpad(regexp_extract({x}, {mdy}, 2), 2, '0')
      WHEN regexp_matches({x}, {dmy}) AND coalesce({sm}, 0) > 0 THEN regexp_extract({x}, {dmy}, 3) || '-' ||
           lpad(CAST({sm} AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract({x}, {dmy}, 1), 2, '0')
      WHEN regexp_matches({x}, {lng}) AND coalesce({lm}, 0) > 0 THEN regexp_extract({x}, {lng}, 3) || '-' ||
           lpad(CAST({lm} AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract({x}, {lng}, 2), 2, '0')
      END)"""
