"""M6 - chunked responses: reassembly with early field emission (batch form
of R1; the streaming form is in ``ledgerlens.streaming``)."""

from __future__ import annotations

from ledgerlens.operators import chunks as CH
from ledgerlens.plans.oracle_base import js_num, with_base
from ledgerlens.plans.registry import query
from ledgerlens.plans.validation import LINE_SUMS, MERGE_CTES, det_rows
from ledgerlens.sources.invoices import AS_OF, invoice_records

SIZE_SQL = "(16 + order_key % 41)"


def responses(spark, sf_dir):
    """One streamed response per record: its JSON text and a chunk size."""
    return invoice_records(spark, sf_dir).selectExpr(
        "doc_id AS response_id", f"{CH.record_json_sql()} AS text", f"CAST({SIZE_SQL} AS INT) AS size")


def response_chunks(spark, sf_dir):
    return CH.chunk_rows(responses(spark, sf_dir))


def _js(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'null' ELSE '\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"' END")


def _num(x: str) -> str:
    return f"coalesce({js_num(x)}, 'null')"


def _field(name: str, v: str, conf: str, rsn: str) -> str:
    return f"'\"{name}\":{{\"value\":' || {v} || ',\"confidence\":' || {_js(conf)} || ',\"reasoning\":' || {_js(rsn)} || '}}'"


_PIECES = [
    _field("invoice_number", _js("inv_no"), "conf0", "rsn0"),
    (f"'\"vendor\":{{\"name\":' || {_js('vendor_name')} || ',\"address\":' || {_js('vendor_address')} || "
     f"',\"confidence\":' || {_js('conf1')} || ',\"reasoning\":' || {_js('rsn1')} || '}}'"),
    _field("bill_date", _js("bill"), "conf2", "rsn2"),
    _field("due_date", _js("due"), "conf3", "rsn3"),
    _field("po_number", _js("po"), "conf4", "rsn4"),
    _field("subtotal", _num("sub"), "conf5", "rsn5"),
    _field("tax", _num("tax"), "conf6", "rsn6"),
    _field("total", _num("total"), "conf7", "rsn7"),
    _field("currency", _js("currency"), "conf8", "rsn8"),
    "'\"line_items\":[' || coalesce(ij.items, '') || ']'",
    "'\"flags\":[' || coalesce(fj.flags, '') || ']'",
]
_ITEM = (f"'{{\"description\":' || {_js('description')} || ',\"quantity\":' || {_num('quantity')} || "
         f"',\"unit_price\":' || {_num('unit_price')} || ',\"amount\":' || {_num('amount')} || "
         f"',\"reasoning\":' || {_js(chr(39) + 'Line ' + chr(39) + ' || CAST(ln AS VARCHAR)')} || '}}'")
_FLAG = f"'{{\"severity\":' || {_js('severity')} || ',\"message\":' || {_js('message')} || '}}'"
_KEYS = "[" + ", ".join(f"'{k}'" for k in CH.STREAM_KEYS) + "]"

CHUNK_SQL = f""",
ij AS (SELECT k, string_agg({_ITEM}, ',' ORDER BY pos) AS items FROM items GROUP BY k),
fj AS (SELECT k, string_agg({_FLAG}, ',' ORDER BY pos) AS flags FROM mflags GROUP BY k),
pieces AS (
  SELECT inv.doc_id, inv.k, {SIZE_SQL.replace('order_key', 'inv.k')} AS size, [{", ".join(_PIECES)}] AS ps
  FROM inv LEFT JOIN ij ON ij.k = inv.k LEFT JOIN fj ON fj.k = inv.k),
exploded AS (SELECT doc_id, size, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS field_no FROM pieces),
pos AS (
  SELECT *, 2 + coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY field_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM exploded)
SELECT doc_id AS response_id, {_KEYS}[field_no + 1] AS field, CAST(field_no AS INTEGER) AS field_no,
       CAST((start + length(p) - 2) // size AS BIGINT) AS seq,
       CAST(length(p) - length({_KEYS}[field_no + 1]) - 3 AS BIGINT) AS value_chars
FROM pos"""


@query("chunk_reassembly", with_base(CHUNK_SQL))
def q_chunk_reassembly(spark, sf_dir):
    """R1 batch form over every record's JSON text cut into chunks."""
    return CH.field_events(response_chunks(spark, sf_dir)).select(
        "response_id", "field", "field_no", "seq", "value_chars")


# ------------------------------------------------------------------ SSE
from ledgerlens.sources.sse import parse_sse  # noqa: E402

SSE_SPARK = ("concat('event: progress\\ndata: {\"phase\":\"parsing\"}\\n\\n', "
             "'event: field\\ndata: ', record.invoice_number.value, '\\n\\n', "
             "'data: ', doc_id, '\\n\\n', '\\n\\n', "
             "'event: x\\nevent:  field \\ndata: first\\ndata: ', coalesce(record.po_number.value, ''), '\\n\\n', "
             "'event: complete\\ndata: {\"partial')")
SSE_DUCK = ("'event: progress' || chr(10) || 'data: {\"phase\":\"parsing\"}' || chr(10) || chr(10) || "
            "'event: field' || chr(10) || 'data: ' || inv_no || chr(10) || chr(10) || "
            "'data: ' || doc_id || chr(10) || chr(10) || chr(10) || chr(10) || "
            "'event: x' || chr(10) || 'event:  field ' || chr(10) || 'data: first' || chr(10) || 'data: ' || "
            "coalesce(po, '') || chr(10) || chr(10) || 'event: complete' || chr(10) || 'data: {\"partial'")
NL2 = "chr(10) || chr(10)"


@query("sse_events", with_base(f""",
t AS (SELECT doc_id, {SSE_DUCK} AS text FROM inv),
p AS (SELECT doc_id, text, string_split(text, {NL2}) AS parts FROM t),
m AS (SELECT doc_id, parts[len(parts)] AS remainder, unnest(parts[1:len(parts) - 1]) AS msg,
             generate_subscripts(parts[1:len(parts) - 1], 1) - 1 AS pos FROM p),
e AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, remainder,
        coalesce(list_filter(list_transform(string_split(msg, chr(10)), lambda l: CASE WHEN starts_with(l, 'event: ')
          THEN regexp_replace(substr(l, 8), '^\\s+|\\s+$', '', 'g') END), lambda x: x IS NOT NULL)[-1], 'message') AS event,
        list_filter(list_transform(string_split(msg, chr(10)), lambda l: CASE WHEN starts_with(l, 'data: ')
          THEN substr(l, 7) END), lambda x: x IS NOT NULL)[-1] AS data
      FROM m WHERE regexp_replace(msg, '^\\s+|\\s+$', '', 'g') <> '')
SELECT doc_id, pos, event, data, remainder FROM e WHERE data IS NOT NULL AND data <> ''"""))
def q_sse_events(spark, sf_dir):
    """S9 over an event-stream text per document (progress, field, a
    default-event message, an empty message, repeated event/data lines and
    an unfinished remainder)."""
    t = invoice_records(spark, sf_dir).selectExpr("doc_id", f"{SSE_SPARK} AS text")
    return parse_sse(t, "text")


# -------------------------------------------------- record source, completion
# per residue of the order key: a change to the response text that keeps the head up to the flags, and the reason it must give
_CUT = "regexp_extract(text, '(?s)^(.*),\"flags\":', 1)"
_P = "instr(text, '\"reasoning\":')"
_BROKEN = (
    ("text", None),
    (f"concat({_CUT}, ',\"flags\":[{{\"severity\":null,\"message\":\"m\"}}]}}')", "wrong-type"),
    (f"concat({_CUT}, ',\"flags\":[{{\"message\":\"m\"}}]}}')", "missing-key"),
    (f"concat({_CUT}, ',\"flags\":[{{\"severity\":\"info\",\"message\":null}}]}}')", "wrong-type"),
    (f"concat({_CUT}, ',\"flags\":[{{\"severity\":\"info\",\"message\":5}}]}}')", "wrong-type"),
    (f"concat({_CUT}, ',\"flags\":[{{\"severity\":\"fatal\",\"message\":\"m\"}}]}}')", "bad-enum"),
    (f"concat({_CUT}, '}}')", "missing-key"),
    (f"concat({_CUT}, ',\"flags\":{{}}}}')", "wrong-type"),
    (f"concat({_CUT}, ',\"flags\":[],\"more\":[1, {{}}]}}')", None),
    (_CUT, "invalid-json"),
    ("concat('[', text, ']')", "wrong-type"),
    ("regexp_replace(text, '^(\\\\{\"invoice_number\":\\\\{\"value\":\"[^\"]*\",\"confidence\":)\"[a-z]+\"', '$1\"certain\"')", "bad-enum"),
    (f"concat(substr(text, 1, {_P} - 1), '\"reason\":', substr(text, {_P} + 12))", "missing-key"),
    ("regexp_replace(text, '^\\\\{\"invoice_number\":\\\\{\"value\":\"INV-(\\\\d+)\"', '{{\"invoice_number\":{{\"value\":$1')".replace("{{", "{"), "wrong-type"),
    ("regexp_replace(text, '^\\\\{\"invoice_number\":\\\\{\"value\":\"[^\"]*\",', '{{\"invoice_number\":{{')".replace("{{", "{"), "missing-key"),
    ("replace(text, ',\"amount\":', ',\"amt\":')", "missing-key"),
)


def _reason_sql(k: str, n_items: str) -> str:
    last = len(_BROKEN) - 1
    return (f"CASE {k} % {len(_BROKEN)} " + " ".join(f"WHEN {i} THEN {'NULL' if r is None else repr(r)}" for i, (_, r) in enumerate(_BROKEN[:last]))
            + f" ELSE CASE WHEN {n_items} > 0 THEN '{_BROKEN[last][1]}' END END")


def broken_responses(spark, sf_dir):
    r = invoice_records(spark, sf_dir).selectExpr("doc_id", "order_key", f"{CH.record_json_sql()} AS text")
    cases = " ".join(f"WHEN {i} THEN {x}" for i, (x, _) in enumerate(_BROKEN))
    return r.selectExpr("doc_id", "order_key", f"CASE order_key % {len(_BROKEN)} {cases} END AS value")


@query("record_source", with_base(f"""
SELECT doc_id, error, CASE WHEN error IS NULL THEN total END AS total,
       CASE WHEN error IS NULL THEN CAST(n_items AS INTEGER) END AS n_items
FROM (SELECT doc_id, total, n_items, {_reason_sql('k', 'n_items')} AS error FROM inv) t"""))
def q_record_source(spark, sf_dir):
    """Records as JSON text, fifteen in sixteen of them changed; every rejection with its reason."""
    from ledgerlens.sources.records import parse_records
    return parse_records(broken_responses(spark, sf_dir), "value").selectExpr(
        "doc_id", "error", "record.total.value AS total", "size(record.line_items) AS n_items")


@query("response_completion", with_base(LINE_SUMS + f""",
det AS ({det_rows('src')})""" + MERGE_CTES + f""",
n AS (SELECT k, count(*) AS n_flags FROM firsts GROUP BY k),
model_n AS (SELECT d.k, count(*) AS n_flags FROM det d GROUP BY d.k),
o AS (SELECT inv.k, inv.doc_id, {_reason_sql('inv.k', 'inv.n_items')} AS error, (inv.k % 90) / 75.0 AS cost,
        CASE WHEN inv.k % 3 = 0 THEN 0.5 END AS cap, inv.k % {len(_BROKEN)} AS slot FROM inv)
SELECT o.doc_id AS response_id, CASE WHEN error IS NULL AND NOT coalesce(cost > 1.0 OR cost > cap, false) THEN 'complete' ELSE 'error' END AS type,
  CASE WHEN error IS NOT NULL THEN '{CH.BAD_CODE}' WHEN coalesce(cost > 1.0 OR cost > cap, false) THEN '{CH.CAP_CODE}' END AS code,
  CASE WHEN error = 'invalid-json' THEN '{CH.BAD_JSON}' WHEN error IS NOT NULL THEN '{CH.BAD_SCHEMA}'
       WHEN coalesce(cost > 1.0 OR cost > cap, false) THEN '{CH.CAP_MESSAGE}' END AS message,
  CASE WHEN error IS NULL AND NOT coalesce(cost > 1.0 OR cost > cap, false) THEN
       CAST(coalesce(CASE WHEN slot = 8 THEN model_n.n_flags ELSE n.n_flags END, 0) AS INTEGER) END AS n_flags
FROM o LEFT JOIN n ON n.k = o.k LEFT JOIN model_n ON model_n.k = o.k"""))
def q_response_completion(spark, sf_dir):
    """R2: chunked responses, some broken and some over the cost cap, each to its closing event."""
    src = broken_responses(spark, sf_dir)
    chunks = CH.chunk_rows(src.selectExpr("doc_id AS response_id", "value AS text", f"CAST({SIZE_SQL} AS INT) AS size"))
    calls = src.selectExpr("doc_id AS response_id", "(order_key % 90) / 75D AS cost", "CASE WHEN order_key % 3 = 0 THEN 0.5D END AS cap")
    return CH.final_outcome(CH.completed(chunks), calls, AS_OF).selectExpr(
        "response_id", "type", "code", "message", "CASE WHEN type = 'complete' THEN size(record.flags) END AS n_flags")
