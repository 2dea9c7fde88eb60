"""Exports: CSV summary and line-item lines (S10-S13), cell encoding (S12),
reasoning redaction (P2), webhook payload (S14), result JSON (S15).

CSV lines are built as text columns (not the built-in CSV writer, which
escapes quotes with a backslash, trims cells and rewrites LF inside cells)
and written with ``write.text(lineSep='\\r\\n')``. The header is written by
the sink once. Everything is a per-row projection (line items by
``posexplode_outer``); no shuffle but the sink's, in which a document
travels once for all formats, as one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.sql import csv_cell
from ledgerlens.schemas import CONFIDENCE_FIELDS
from ledgerlens.session import open_files

# Column headers of the two CSV formats.
SUMMARY_HEADERS = ("invoice_number", "vendor_name", "vendor_address", "bill_date", "due_date",
                   "po_number", "subtotal", "tax", "total", "currency", "memo", "flags")
LINE_ITEM_HEADERS = ("invoice_number", "vendor_name", "bill_date", "due_date", "total",
                     "currency", "line_description", "line_quantity", "line_unit_price",
                     "line_amount")


def header_line(fmt: str = "summary") -> str:
    heads = SUMMARY_HEADERS if fmt == "summary" else LINE_ITEM_HEADERS
    return ",".join(heads)


def memo_sql(r: str = "record") -> str:
    """Non-empty item descriptions joined with `` | ``."""
    return (f"array_join(filter(transform({r}.line_items, x -> x.description), "
            f"d -> d IS NOT NULL AND d <> ''), ' | ')")


def flag_string_sql(flags: str = "record.flags") -> str:
    """``severity: message`` joined with ``; ``."""
    return f"array_join(transform({flags}, f -> concat(f.severity, ': ', f.message)), '; ')"


def _header_cells(r: str = "record") -> list[str]:
    """The cells of the summary line before the memo."""
    return [csv_cell(f"{r}.invoice_number.value"), csv_cell(f"{r}.vendor.name"),
            csv_cell(f"{r}.vendor.address"), csv_cell(f"{r}.bill_date.value"),
            csv_cell(f"{r}.due_date.value"), csv_cell(f"{r}.po_number.value"),
            csv_cell(f"{r}.subtotal.value", True), csv_cell(f"{r}.tax.value", True),
            csv_cell(f"{r}.total.value", True), csv_cell(f"{r}.currency.value")]


def summary_lines(records: DataFrame) -> DataFrame:
    """doc_id, line - one CSV row per invoice."""
    cells = [*_header_cells(), csv_cell(memo_sql()), csv_cell(flag_string_sql())]
    return records.selectExpr("doc_id", "concat_ws(',', " + ", ".join(cells) + ") AS line")


#: Places of the header cells that every line of an invoice repeats.
_REPEATED = (0, 1, 3, 4, 8, 9)


def _invoice_cells() -> list[str]:
    """The cells that every line of an invoice repeats."""
    return [_header_cells()[i] for i in _REPEATED]


def _item_cells(li: str) -> list[str]:
    return [csv_cell(f"{li}.description"), csv_cell(f"{li}.quantity", True),
            csv_cell(f"{li}.unit_price", True), csv_cell(f"{li}.amount", True)]


def line_item_lines(records: DataFrame) -> DataFrame:
    """doc_id, item_pos, line - one CSV row per line item, header
    fields repeated; an invoice without items gives one row with four
    empty cells (item_pos null)."""
    x = records.selectExpr("doc_id", "record", "posexplode_outer(record.line_items) AS (item_pos, li)")
    cells = _invoice_cells() + _item_cells("li")
    return x.selectExpr("doc_id", "CAST(item_pos AS BIGINT) AS item_pos",
                        "concat_ws(',', " + ", ".join(cells) + ") AS line")


def _item_block(cells: list[str]) -> str:
    """The lines of a document's items, of its repeated cells ``head``, its items ``its`` and the cells of an item ``x``."""
    line = "concat_ws(',', head, " + ", ".join(cells) + ")"
    return f"CASE WHEN size(its) > 0 THEN array_join(transform(its, x -> {line}), '\\r\\n') ELSE concat(head, ',,,,') END"


def line_item_blocks(records: DataFrame) -> DataFrame:
    """S11 for the sink: doc_id, line - the lines of ``line_item_lines`` of one document, in item order, as one text
    with CRLF between them. The repeated cells are built once per document."""
    x = records.selectExpr("doc_id", "concat_ws(',', " + ", ".join(_invoice_cells()) + ") AS head", "record.line_items AS its")
    return x.selectExpr("doc_id", f"{_item_block(_item_cells('x'))} AS line")


def to_csv_lines(records: DataFrame, fmt: str = "summary") -> DataFrame:
    """Format dispatch (``summary`` default, or ``line_items``)."""
    return line_item_lines(records) if fmt == "line_items" else summary_lines(records)


FORMATS = ("summary", "line_items")
_GAP, _MARK = "char(1)", "char(2)"


def _packed() -> str:
    """What the lines of all formats show of a document, as one text: the header cells, the flags' cell and, for each item, its description and
    its cells of numbers, with a control character between them (and that written as a pair where a text has it). One text takes
    two thirds of the bytes that the fields, or the lines of each format, take on the way."""
    def plain(x: str) -> str:
        return f"replace(replace({x}, {_MARK}, concat({_MARK}, 'b')), {_GAP}, concat({_MARK}, 'a'))"
    cells = [plain(c) for c in (*_header_cells(), csv_cell(flag_string_sql()))]
    numbers = "concat_ws(',', " + ", ".join(_item_cells("x")[1:]) + ")"
    items = f"transform(record.line_items, x -> concat({_GAP}, {plain('coalesce(x.description, {0})'.format(repr('')))}, {_GAP}, {numbers}))"
    return f"concat(concat_ws({_GAP}, {', '.join(cells)}), coalesce(array_join({items}, ''), ''))"


def _unpacked(docs: DataFrame) -> DataFrame:
    """summary, block - the line of each document in the one format, and its lines in the other, of its packed text. (To a line, no
    description and an empty one are the same.)"""
    n = len(_header_cells()) + 1
    parts = docs.selectExpr(f"transform(split(text, {_GAP}), p -> replace(replace(p, concat({_MARK}, 'a'), {_GAP}), concat({_MARK}, 'b'), {_MARK})) AS cells")
    parts = parts.selectExpr(
        "cells", "concat_ws(',', " + ", ".join(f"cells[{i}]" for i in _REPEATED) + ") AS head",
        f"CASE WHEN size(cells) > {n} THEN transform(sequence({n}, size(cells) - 2, 2), i -> named_struct('description', cells[i], 'numbers', cells[i + 1])) "
        "ELSE CAST(array() AS ARRAY<STRUCT<description: STRING, numbers: STRING>>) END AS its")
    parts = parts.selectExpr("*", "array_join(filter(transform(its, x -> x.description), d -> d <> ''), ' | ') AS memo")
    header = ", ".join(f"cells[{i}]" for i in range(n - 1))
    return parts.selectExpr(f"concat_ws(',', {header}, {csv_cell('memo')}, cells[{n - 1}]) AS summary",
                            f"{_item_block([csv_cell('x.description'), 'x.numbers'])} AS line_items")


def _texts(records: DataFrame, formats: tuple[str, ...]) -> DataFrame:
    """fmt, line - the header and the lines of each format, in document order and, within a document, item order; a line-items row is all lines of
    a document. Documents travel and are sorted once, as one text. The headers lie in the first partition."""
    order = F.col("doc_id").asc_nulls_first()
    docs = records.selectExpr("doc_id", f"{_packed()} AS text").repartitionByRange(order).sortWithinPartitions(order)
    texts = ", ".join(f"named_struct('fmt', '{f}', 'line', {f})" for f in formats)
    rows = _unpacked(docs).selectExpr(f"inline(array({texts}))")
    heads = records.sparkSession.createDataFrame([(f, header_line(f)) for f in formats], "fmt string, line string").coalesce(1)
    return heads.union(rows)


def write_csv(records: DataFrame, path: str, fmt: str = "summary") -> None:
    """S12 / S13 sink: the lines of ``records`` in one format under its own header, in document order and, within a document,
    item order; CRLF between rows. The output is range-partitioned by document and its header is the first part, so the part files
    concatenate to one file. (The text sink ends the last row with CRLF too.)"""
    _texts(records, (fmt if fmt == "line_items" else "summary",)).select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def export_name(fmt: str, run_date: str) -> str:
    """The name of a day's export, by format."""
    return f"invoices-{fmt}-{run_date}.csv"


def write_export(records: DataFrame, folder: str, run_date: str, fmt: str = "summary") -> str:
    """The export of one day and format under its own name in ``folder``; other days and formats stay. Returns the path."""
    path = f"{folder.rstrip('/')}/{export_name(fmt, run_date)}"
    write_csv(records, path, fmt)
    return path


def write_exports(records: DataFrame, folder: str, run_date: str, formats: tuple[str, ...] = FORMATS, compression: str = "none") -> dict[str, str]:
    """The exports of one day in several formats, each as ``write_export`` writes it. Documents travel once for all formats; a
    task writes a file of each, beside the exports, which take the place of earlier ones when all are whole. Returns the paths.
    With ``compression`` ``gzip`` the part files concatenate to one gzip file of the same text."""
    import uuid
    spark = records.sparkSession
    aside = f"{folder.rstrip('/')}/_exports-{uuid.uuid4().hex}"
    with open_files(spark, len(formats)):
        _texts(records, formats).write.partitionBy("fmt").option("lineSep", "\r\n").option("compression", compression).text(aside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(aside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = {f: f"{folder.rstrip('/')}/{export_name(f, run_date)}" for f in formats}
    for f, path in paths.items():
        fs.delete(hadoop.Path(path), True)
        if not fs.rename(hadoop.Path(f"{aside}/fmt={f}"), hadoop.Path(path)):
            raise OSError(f"{path} can't be written")
    fs.delete(hadoop.Path(aside), True)
    return paths


def redact(records: DataFrame, col: str = "record") -> DataFrame:
    """Drop ``reasoning`` from the nine header structs and every line
    item; flags kept; custom fields not carried."""
    rec = F.col(col)
    for f in CONFIDENCE_FIELDS:
        rec = rec.withField(f, F.col(f"{col}.{f}").dropFields("reasoning"))
    rec = rec.withField("line_items", F.transform(F.col(f"{col}.line_items"),
                                                 lambda x: x.dropFields("reasoning")))
    return records.withColumn(col, rec)


def correlation_id_sql(key: str) -> str:
    """F15 in batch: a UUID-shaped id from a hash of the key, so reruns give
    the same ids (a streaming sink may use ``uuid()`` instead)."""
    h = f"md5({key})"
    return (f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', "
            f"substr({h}, 17, 4), '-', substr({h}, 21, 12))")


def webhook_payloads(records: DataFrame, verbose: bool = False, idempotency_key: str | None = None,
                     timestamp_sql: str = "current_timestamp()") -> DataFrame:
    """One payload per record: event, timestamp, correlation_id,
    idempotency_key (or null), invoice (redacted unless verbose),
    confidence_summary (A2); ``payload`` is the JSON text with nulls kept."""
    from ledgerlens.operators.validation import confidence_counts_sql
    src = records if verbose else redact(records)
    idem = "CAST(NULL AS STRING)" if idempotency_key is None else idempotency_key
    counts = [c.rsplit(" AS ", 1) for c in confidence_counts_sql("record")]
    summary = "named_struct(" + ", ".join(f"'{name}', {expr}" for expr, name in counts) + ")"
    out = src.selectExpr("doc_id", "'invoice.extracted' AS event",
                         f"date_format({timestamp_sql}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") AS timestamp",
                         f"{correlation_id_sql('doc_id')} AS correlation_id",
                         f"{idem} AS idempotency_key", "record AS invoice",
                         f"{summary} AS confidence_summary")
    return out.withColumn("payload", F.to_json(
        F.struct("event", "timestamp", "correlation_id", "idempotency_key", "invoice",
                 "confidence_summary"), {"ignoreNullFields": "false"}))


def preview_sql(text: str, n: int = 500) -> str:
    """The first ``n`` characters (500 for a webhook response body, 60
    for an error line in the evaluation log)."""
    return f"substring({text}, 1, {n})"


MAX_INVOICES_PER_REQUEST = 100


def check_request_sizes(requests: DataFrame, request_col: str = "request_id",
                        max_invoices: int = MAX_INVOICES_PER_REQUEST) -> DataFrame:
    """S6 batch rule of the CSV export: a request carries 1..100 invoices;
    returns request, invoices, error (``empty`` / ``too-many`` / null).
    A partial aggregate, so a huge request costs nothing extra."""
    return (requests.groupBy(request_col).agg(F.count("record").alias("invoices"))
            .selectExpr(request_col, "invoices",
                        f"CASE WHEN invoices = 0 THEN 'empty' WHEN invoices > {max_invoices} THEN 'too-many' "
                        "END AS error"))
