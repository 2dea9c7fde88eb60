"""Spark SQL text builders for the expression helpers.

Every helper takes SQL text (a column name or an expression) and returns SQL
text, so a whole projection is handed to the JVM in one ``selectExpr`` call
and parsed there: building the plan costs one round trip per column instead
of one per function node."""

from __future__ import annotations

# Month names the date normaliser accepts.
MONTHS_SHORT = ("jan", "feb", "mar", "apr", "may", "jun",
                "jul", "aug", "sep", "oct", "nov", "dec")
MONTHS_LONG = ("january", "february", "march", "april", "may", "june",
               "july", "august", "september", "october", "november", "december")

ISO_RE = r"^\\d{4}-\\d{2}-\\d{2}$"
MDY_RE = r"^(\\d{1,2})/(\\d{1,2})/(\\d{4})$"
DMONY_RE = r"^(\\d{1,2})-([A-Za-z]{3})-(\\d{4})$"
LONG_RE = r"^([A-Za-z]+)\\s+(\\d{1,2}),?\\s+(\\d{4})$"


def lit(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def round2(x: str) -> str:
    """``Math.round(n*100)/100``: ties toward +infinity (not ``round(n,2)``)."""
    return f"(floor(({x}) * 100 + 0.5) / 100)"


def js_number(x: str) -> str:
    """``String(n)`` for a double: shortest digits, no ``.0``, no exponent
    for money-sized values."""
    s = f"CAST({x} AS STRING)"
    plain = f"regexp_replace(CAST(try_cast({s} AS DECIMAL(38,18)) AS STRING), '\\\\.?0+$', '')"
    return (f"(CASE WHEN instr({s}, 'E') > 0 THEN coalesce({plain}, {s}) "
            f"WHEN {s} LIKE '%.0' THEN substr({s}, 1, char_length({s}) - 2) ELSE {s} END)")


def fixed2(x: str) -> str:
    """``toFixed(2)`` for values that carry at most two decimals. Plain amounts are written by a decimal, which rounds the same
    shortest digits half up and costs less than a format."""
    return f"(CASE WHEN {x} >= 0.01D AND {x} < 1e6D THEN CAST(CAST({x} AS DECIMAL(9,2)) AS STRING) ELSE format_string('%.2f', {x}) END)"


def js_trim(x: str) -> str:
    """``String.prototype.trim``: all Unicode white space at both ends. A text that begins and ends with a visible ASCII character stays."""
    return (f"(CASE WHEN ascii({x}) BETWEEN 33 AND 126 AND ascii(right({x}, 1)) BETWEEN 33 AND 126 THEN {x} "
            f"ELSE regexp_replace({x}, '(?U)^\\\\s+|\\\\s+$', '') END)")


def csv_cell(x: str, numeric: bool = False) -> str:
    """RFC-4180 cell: null -> ''; quoted if it has a quote, comma, CR or LF
    or leading/trailing white space; inner quotes doubled. A number's text
    has none of them."""
    if numeric:
        return f"coalesce({js_number(x)}, '')"
    s = f"CAST({x} AS STRING)"
    return (f"(CASE WHEN {s} IS NULL THEN '' "
            f"WHEN {s} RLIKE '[\",\\r\\n]' OR {js_trim(s)} <> {s} "
            f"THEN concat('\"', replace({s}, '\"', '\"\"'), '\"') ELSE {s} END)")


def _month_no(name_sql: str, names: tuple) -> str:
    arr = "array(" + ", ".join(lit(m) for m in names) + ")"
    return f"array_position({arr}, lower({name_sql}))"


def normalize_date(x: str) -> str:
    """ISO as is; ``M/D/YYYY``; ``D-Mon-YYYY``; ``Month D, YYYY`` (comma
    optional, any case) -> ``YYYY-MM-DD`` built as text (no calendar check);
    anything else -> null. The JS engine's lenient fallback parse is not
    reproduced."""
    def ex(rx, g):
        return f"regexp_extract({x}, '{rx}', {g})"
    sm = _month_no(ex(DMONY_RE, 2), MONTHS_SHORT)
    lm = _month_no(ex(LONG_RE, 1), MONTHS_LONG)
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN CAST(NULL AS STRING) "
            f"WHEN {x} RLIKE '{ISO_RE}' THEN {x} "
            f"WHEN {x} RLIKE '{MDY_RE}' THEN concat({ex(MDY_RE, 3)}, '-', lpad({ex(MDY_RE, 1)}, 2, '0'), '-', "
            f"lpad({ex(MDY_RE, 2)}, 2, '0')) "
            f"WHEN {x} RLIKE '{DMONY_RE}' AND {sm} > 0 THEN concat({ex(DMONY_RE, 3)}, '-', "
            f"lpad(CAST({sm} AS STRING), 2, '0'), '-', lpad({ex(DMONY_RE, 1)}, 2, '0')) "
            f"WHEN {x} RLIKE '{LONG_RE}' AND {lm} > 0 THEN concat({ex(LONG_RE, 3)}, '-', "
            f"lpad(CAST({lm} AS STRING), 2, '0'), '-', lpad({ex(LONG_RE, 2)}, 2, '0')) END)")


def parsed_date(x: str) -> str:
    """The calendar date of a date text in any form that ``normalize_date`` knows; null for other texts."""
    return f"try_to_date({normalize_date(x)}, 'yyyy-MM-dd')"


#: The short escapes of JSON text; other control characters are written as four lower-case hex digits.
_SHORT = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def json_string(x: str) -> str:
    """``JSON.stringify`` of a text: quotes, backslashes and control characters escaped; null -> ``null``."""
    s = f"replace(replace({x}, '\\\\', '\\\\\\\\'), '\"', '\\\\\"')"
    full = s
    for c in range(32):
        full = f"replace({full}, char({c}), '\\\\{_SHORT.get(c, f'u{c:04x}')}')"
    return (f"(CASE WHEN {x} IS NULL THEN 'null' WHEN NOT {x} RLIKE '[\"\\\\\\\\\\\\x00-\\\\x1f]' THEN concat('\"', {x}, '\"') "
            f"WHEN {x} RLIKE '[\\\\x00-\\\\x1f]' THEN concat('\"', {full}, '\"') ELSE concat('\"', {s}, '\"') END)")


def pct(n: str, d: str) -> str:
    """``n/d*100`` with one decimal and '%', ``n/a`` when d = 0; rounded
    half up on the exact ratio (integer arithmetic)."""
    t = f"((2 * CAST({n} AS BIGINT) * 1000 + CAST({d} AS BIGINT)) div (2 * CAST({d} AS BIGINT)))"
    return (f"(CASE WHEN {d} = 0 THEN 'n/a' ELSE concat(CAST({t} div 10 AS STRING), '.', "
            f"CAST({t} % 10 AS STRING), '%') END)")
