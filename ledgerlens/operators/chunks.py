"""Streamed responses: record -> JSON text (F13, ``JSON.stringify`` layout:
numbers as ``String(n)``), text cut into chunks, and chunk reassembly with
early field emission (R1) plus completion (R2).

R1 semantics: per response, chunks are appended in order; each of the 11
top-level keys is emitted once, when its ``{...}`` / ``[...]`` value closes
(string- and escape-aware, counting only the value's own bracket kind) and
parses as JSON; primitive values and unparsable slices are not emitted.
Within one chunk, emissions follow the key-list order.

Batch form: one group per response, bounded by the response cap (4,096
output tokens).
The stream form (``ledgerlens.streaming.chunks``) keeps the buffer and the
emitted keys as state per response.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.sql import js_number, json_string

# The top-level keys the parser watches, in emission order.
STREAM_KEYS = ("invoice_number", "vendor", "bill_date", "due_date", "po_number", "subtotal", "tax",
               "total", "currency", "line_items", "flags")

FIELD_EVENT_SCHEMA = ("response_id string, field string, field_no int, seq bigint, "
                      "value_chars bigint, value_json string")


_js = json_string


def _num(x: str) -> str:
    return f"coalesce({js_number(x)}, 'null')"


def record_json_sql(r: str = "record") -> str:
    """The record as ``JSON.stringify`` would print it (key order of the
    schema, no spaces)."""
    def field(name, numeric=False):
        v = _num(f"{r}.{name}.value") if numeric else _js(f"{r}.{name}.value")
        return (f"concat('\"{name}\":{{\"value\":', {v}, ',\"confidence\":', {_js(f'{r}.{name}.confidence')}, "
                f"',\"reasoning\":', {_js(f'{r}.{name}.reasoning')}, '}}')")
    vendor = (f"concat('\"vendor\":{{\"name\":', {_js(f'{r}.vendor.name')}, ',\"address\":', "
              f"{_js(f'{r}.vendor.address')}, ',\"confidence\":', {_js(f'{r}.vendor.confidence')}, "
              f"',\"reasoning\":', {_js(f'{r}.vendor.reasoning')}, '}}')")
    item = (f"x -> concat('{{\"description\":', {_js('x.description')}, ',\"quantity\":', {_num('x.quantity')}, "
            f"',\"unit_price\":', {_num('x.unit_price')}, ',\"amount\":', {_num('x.amount')}, "
            f"',\"reasoning\":', {_js('x.reasoning')}, '}}')")
    flag = f"f -> concat('{{\"severity\":', {_js('f.severity')}, ',\"message\":', {_js('f.message')}, '}}')"
    items = f"concat('\"line_items\":[', array_join(transform({r}.line_items, {item}), ','), ']')"
    flags = f"concat('\"flags\":[', array_join(transform({r}.flags, {flag}), ','), ']')"
    parts = [field("invoice_number"), vendor, field("bill_date"), field("due_date"), field("po_number"),
             field("subtotal", True), field("tax", True), field("total", True), field("currency"), items, flags]
    return "concat('{', concat_ws(',', " + ", ".join(parts) + "), '}')"


def chunk_rows(responses: DataFrame, text: str = "text", size_sql: str = "size", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cut each response text into chunks of ``size`` characters:
    response_id, seq, chunk and the columns to ``keep`` (one regex split per response, no lambda)."""
    return responses.selectExpr(
        "response_id", *keep, f"posexplode(regexp_extract_all({text}, concat('(?s).{{1,', CAST({size_sql} AS STRING), '}}'), 0)) "
        "AS (seq, chunk)").selectExpr("response_id", "CAST(seq AS BIGINT) AS seq", "chunk", *keep)


_SPECIAL = re.compile(r'[{}\[\]"\\]')
_IN_STRING = re.compile(r'["\\]')


class _KeyScan:
    """Where a key's value begins and how far it has been read; places count from the response's first character."""
    __slots__ = ("start", "open_c", "close_c", "i", "depth", "in_str", "done")

    def __init__(self, start: int, open_c: str):
        self.start, self.open_c = start, open_c
        self.close_c = "}" if open_c == "{" else "]"
        self.i, self.depth, self.in_str, self.done = start, 0, False, False


_KEY_RE = re.compile('"(' + "|".join(STREAM_KEYS) + ')":')
_MAX_PAT = max(len(k) for k in STREAM_KEYS) + 3


class FieldParser:
    """Incremental field emission over appended text.

    Same decisions as re-scanning the whole buffer on every chunk (the first
    ``"key":`` never moves once found, and a scan of a prefix is a prefix of
    the scan), but keys are located with one regex over the new text only,
    each located key's scan resumes where it stopped and jumps between
    structural characters, so a response costs linear time.

    ``forget`` drops all text but the few characters in which a key may have begun; a parser that is restored from
    what is left (``base``, ``buffer``, places) goes on from there, and asks ``earlier`` for the dropped text only to give out a value that
    began in it - once for each key at most."""

    def __init__(self, earlier=None):
        self.buffer, self.base = "", 0         # text from place ``base`` on
        self.earlier = earlier                 # () -> the text before ``base``
        self.emitted: set[str] = set()
        self.scans: dict[str, _KeyScan] = {}
        self._located: dict[str, int] = {}     # key -> end of its first '"key":' (and of white space behind it)
        self._searched = 0
        self.looked_at = 0                     # characters searched or scanned so far, for measurements

    @property
    def length(self) -> int:
        return self.base + len(self.buffer)

    def feed(self, chunk: str) -> list[tuple[str, str]]:
        self.buffer += chunk
        buf, base = self.buffer, self.base
        if len(self._located) < len(STREAM_KEYS):
            start = max(0, self._searched - _MAX_PAT - base)
            self.looked_at += len(buf) - start
            for m in _KEY_RE.finditer(buf, start):
                k = m.group(1)
                if k not in self._located:
                    self._located[k] = base + m.end()
            self._searched = base + len(buf)
        out = []
        for key in STREAM_KEYS:
            if key in self.emitted or key not in self._located:
                continue
            value = self._try(key)
            if value is not None:
                self.emitted.add(key)
                out.append((key, value))
        return out

    def forget(self) -> str:
        """Drops (and returns) the text that no search needs any more."""
        cut = max(0, len(self.buffer) - _MAX_PAT)
        gone, self.buffer, self.base = self.buffer[:cut], self.buffer[cut:], self.base + cut
        return gone

    def _try(self, key: str):
        buf, base = self.buffer, self.base
        st = self.scans.get(key)
        if st is None:
            start = self._located[key] - base
            while start < len(buf) and buf[start].isspace():
                start += 1
            self._located[key] = base + start
            if start >= len(buf):
                return None
            self.scans[key] = st = _KeyScan(base + start, buf[start])
            if buf[start] not in "{[":
                st.done = True          # primitive value: never emitted
                return None
        if st.done or st.i >= base + len(buf):
            return None
        self.looked_at += base + len(buf) - st.i
        close, i, st.depth, st.in_str = scan_value(buf, st.open_c, st.close_c, st.i - base, st.depth, st.in_str)
        st.i = base + i
        if close is None:
            return None
        st.done = True
        if st.start >= base:
            text = buf[st.start - base:close + 1]
        else:
            self.looked_at += base - st.start
            text = self.earlier()[st.start:base] + buf[:close + 1]
        try:
            json.loads(text)
        except ValueError:
            return None
        return text


def scan_value(buf: str, open_c: str, close_c: str, i: int, depth: int, in_str: bool):
    """Bracket scan from position ``i``: string- and escape-aware, counting
    only ``open_c``/``close_c``. Returns (close index or None, i, depth,
    in_str) so a caller can resume when more text arrives."""
    n = len(buf)
    while i < n:
        if in_str:
            m = _IN_STRING.search(buf, i)
            if m is None:
                return None, n, depth, True
            i = m.start()
            if buf[i] == "\\":
                i += 2
                continue
            in_str = False
            i += 1
            continue
        m = _SPECIAL.search(buf, i)
        if m is None:
            return None, n, depth, False
        i = m.start()
        ch = buf[i]
        if ch == '"':
            in_str = True
        elif ch == open_c:
            depth += 1
        elif ch == close_c:
            depth -= 1
            if depth == 0:
                return i, i + 1, 0, False
        i += 1
    return None, i, depth, in_str


_DECODER = json.JSONDecoder()


def final_events(text: str, seqs, lens) -> list[tuple]:
    """R1 outcome from the whole response at once: for each key, its first
    ``"key":``, the close of its value and whether that parses; the event's
    chunk is the one holding the close character. Equal to feeding the
    chunks one by one: a prefix scan is a prefix of the full scan, and a value that parses where it starts ends at the
    bracket that closes it."""
    located = {}
    for m in _KEY_RE.finditer(text):
        located.setdefault(m.group(1), m.end())
        if len(located) == len(STREAM_KEYS):
            break
    ends = np.cumsum(lens)
    out = []
    for no, key in enumerate(STREAM_KEYS):
        start = located.get(key)
        if start is None:
            continue
        while start < len(text) and text[start].isspace():
            start += 1
        if start >= len(text) or text[start] not in "{[":
            continue
        try:
            _, end = _DECODER.raw_decode(text, start)
        except (ValueError, RecursionError):
            continue
        j = int(np.searchsorted(ends, end - 1, side="right"))
        out.append((key, no, int(seqs[j]), end - start, text[start:end]))
    return out


def gathered(chunks: DataFrame) -> DataFrame:
    """One row per response: its text, chunks in order, and the chunks' numbers and lengths (``seqs``, ``lens``). Chunks that stand
    one behind the other in their input become one row before they travel, and are sorted only where they arrive, in small
    partitions; chunks in any other order are cut apart there and put in order."""
    kind = chunks.schema["response_id"].dataType.simpleString()
    pieces = chunks.selectExpr("response_id", "CAST(seq AS BIGINT) AS seq", "chunk").mapInArrow(
        _pieces, f"response_id {kind}, seq bigint, text string, lens array<int>")
    n = _SPREAD * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pieces.repartition(n, "response_id").groupBy("response_id").agg(F.expr("collect_list(struct(seq, text, lens)) AS ps"))
    cut = ("sort_array(flatten(transform(ps, p -> transform(p.lens, (l, i) -> named_struct('seq', p.seq + i, 'c', "
           "substr(p.text, 1 + aggregate(slice(p.lens, 1, i), 0, (a, x) -> a + x), l))))))")
    return met.selectExpr("response_id", "ps", f"CASE WHEN size(ps) > 1 THEN {cut} END AS cs").selectExpr(
        "response_id", "CASE WHEN cs IS NULL THEN ps[0].text ELSE array_join(cs.c, '') END AS text",
        "CASE WHEN cs IS NULL THEN transform(ps[0].lens, (l, i) -> ps[0].seq + i) ELSE cs.seq END AS seqs",
        "CASE WHEN cs IS NULL THEN ps[0].lens ELSE transform(cs.c, c -> char_length(c)) END AS lens")


#: Partitions for whole responses, times the session's: a task sorts them by response, and they are wide.
_SPREAD = 4


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a response's consecutive chunks, each as one row with the first one's number."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ids, seq, chunk = b.columns
        first = np.ones(n, bool)
        if n > 1:
            goes_on = pc.and_(pc.equal(ids.slice(1), ids.slice(0, n - 1)), pc.equal(pc.subtract(seq.slice(1), seq.slice(0, n - 1)), 1))
            first[1:] = ~pc.fill_null(goes_on, False).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(first)
        ends, chunk = pa.array(np.append(at, n), pa.int32()), pc.fill_null(chunk, "")
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at)), seq.take(pa.array(at)), pc.binary_join(pa.ListArray.from_arrays(ends, chunk), ""),
             pa.ListArray.from_arrays(ends, pc.utf8_length(chunk))], names=["response_id", "seq", "text", "lens"])


def field_events(chunks: DataFrame) -> DataFrame:
    """R1 batch form: one row per emitted field (response, field, chunk seq
    it closed in, value text). Chunks are gathered per response (bounded by
    the response cap) and joined by the JVM; a task gets each text once, with the lengths of its chunks, and
    reads every value where it starts."""
    whole = gathered(chunks)
    return whole.mapInArrow(_events_flat, FIELD_EVENT_SCHEMA)


def _events_flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole responses in, one flat row per emitted field out."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    names = [c.split()[0] for c in FIELD_EVENT_SCHEMA.split(", ")]
    for b in batches:
        at = b.column("seqs").offsets.to_numpy()
        seqs, lens = (b.column(c).values.to_numpy() for c in ("seqs", "lens"))
        rows = [(rid, *event) for rid, text, i, j in zip(b.column("response_id").to_pylist(), b.column("text").to_pylist(), at, at[1:])
                for event in final_events(text, seqs[i:j], lens[i:j])]
        columns = zip(*rows) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


#: The code and the two messages of a response that can't be used (own wording), and the cap's code.
BAD_CODE, BAD_JSON, BAD_SCHEMA = "model-API-failure", "The response is not JSON.", "The response does not match the schema."
CAP_CODE, CAP_MESSAGE = "cost-budget-exceeded", "Cost exceeded cap."
TIMEOUT_CODE, TIMEOUT_MESSAGE = "extraction-timeout", "The response did not end in time."


def whole_texts(chunks: DataFrame) -> DataFrame:
    """One row per response: its text, chunks in order (a response is bounded by the output cap)."""
    return gathered(chunks).selectExpr("response_id", "text", "CAST(size(lens) AS BIGINT) AS n_chunks")


def completed(chunks: DataFrame) -> DataFrame:
    """R2, first half: whole text per response, parsed against the record schema; ``error`` as in the S6 source."""
    from ledgerlens.sources.records import parse_records
    return parse_records(whole_texts(chunks), "text").select("response_id", "n_chunks", "record", "error")


def final_outcome(done: DataFrame, calls: DataFrame | None, as_of: str, shown: str = "record") -> DataFrame:
    """R2: each response ends in one event. ``done(response_id, record, error)``; ``calls(response_id, cost, cap)`` (or None, if ``done`` has these), cap null before
    enough calls are known. ``type`` complete or error, ``code`` and ``message`` of an error (an ``error`` of ``timeout`` has its own),
    ``record`` of a complete one with the rule flags merged, and its ``cost``. A cost over the absolute ceiling or the cap ends in an error though the text is good; an unknown
    cost passes. ``shown``: what a complete response shows in place of its whole record (``<expression of record> AS <name>``); where ``done`` has to
    travel to its calls, only that travels."""
    from ledgerlens.operators.folds import ABSOLUTE_CEILING_USD
    from ledgerlens.operators.validation import validated
    name = shown.rsplit(" AS ", 1)[-1]
    j = validated(done, as_of).selectExpr("response_id", shown, "error", *(["cost", "cap"] if calls is None else []))
    if calls is not None:
        j = j.join(calls.hint("shuffle_hash"), "response_id", "left")
    over = f"coalesce(cost > {ABSOLUTE_CEILING_USD}D OR cost > cap, false)"
    out = j.selectExpr(
        "*", f"CASE WHEN error = 'timeout' THEN '{TIMEOUT_CODE}' WHEN error IS NOT NULL THEN '{BAD_CODE}' WHEN {over} THEN '{CAP_CODE}' END AS code")
    return out.selectExpr(
        "response_id", "CASE WHEN code IS NULL THEN 'complete' ELSE 'error' END AS type", "code",
        f"CASE WHEN error = 'timeout' THEN '{TIMEOUT_MESSAGE}' WHEN error = 'invalid-json' THEN '{BAD_JSON}' WHEN error IS NOT NULL THEN '{BAD_SCHEMA}' "
        f"WHEN code IS NOT NULL THEN '{CAP_MESSAGE}' END AS message",
        f"CASE WHEN code IS NULL THEN {name} END AS {name}", "cost")


def progress_rollup(stream_events: DataFrame) -> DataFrame:
    """Stream events (``type`` progress / field / complete / error, with
    ``phase`` and ``elapsed_ms`` for progress) rolled up by type and phase:
    count, responses, mean and max elapsed time. A partial aggregate."""
    return (stream_events.groupBy("type", "phase").agg(
        F.count("*").alias("events"), F.count_distinct("response_id").alias("responses"),
        F.round(F.avg("elapsed_ms"), 3).alias("avg_elapsed_ms"), F.max("elapsed_ms").alias("max_elapsed_ms")))
