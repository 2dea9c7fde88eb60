"""Evidence lookup (J6) with its search variants.

For each (document, field) the variants are tried in order; the first
variant (>= 2 characters after trim) that occurs in any text line wins, and
the first such line. A document's variants stand as an array beside its text
and ``instr`` finds the first occurrence of each; the line number is the count
of line breaks before it. Work is one row per document: no variant rows, no
variants x lines, and no shuffle when text and values are in one table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.sql import js_trim, lit

# English month names for the date variants.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December")
LABELS = ("Invoice #", "Vendor", "Bill date", "Due date", "PO #", "Subtotal", "Tax", "Total",
          "Currency")


def date_variants_sql(iso: str) -> str:
    """ISO, ``Month D, YYYY``, ``Mon D, YYYY``, ``MM/DD/YYYY``,
    ``DD/MM/YYYY``, ``Month D``; a non-ISO value gives itself; null none."""
    y, mm, dd = (f"substr({iso}, {at}, {n})" for at, n in ((1, 4), (6, 2), (9, 2)))      # read only where it is an ISO date
    months = "array(" + ", ".join(lit(x) for x in MONTHS) + ")"
    mlong = f"try_element_at({months}, CAST({mm} AS INT))"
    day = f"CAST(CAST({dd} AS INT) AS STRING)"
    variants = (f"filter(array({iso}, concat({mlong}, ' ', {day}, ', ', {y}), "
                f"concat(substr({mlong}, 1, 3), ' ', {day}, ', ', {y}), concat({mm}, '/', {dd}, '/', {y}), "
                f"concat({dd}, '/', {mm}, '/', {y}), concat({mlong}, ' ', {day})), v -> v IS NOT NULL AND v <> '')")
    return (f"CASE WHEN {iso} IS NULL OR {iso} = '' THEN CAST(array() AS ARRAY<STRING>) "
            f"WHEN {iso} RLIKE '^\\\\d{{4}}-\\\\d{{2}}-\\\\d{{2}}$' THEN {variants} ELSE array({iso}) END")


def word_fallbacks_sql(s: str) -> str:
    """F8: the whole string, then its words longer than 3 characters."""
    return (f"CASE WHEN {s} IS NULL OR {s} = '' THEN CAST(array() AS ARRAY<STRING>) "
            f"ELSE concat(array({s}), filter(split({s}, '\\\\s+'), w -> char_length(w) > 3)) END")


def money_variants_sql(n: str) -> str:
    """grouped two-decimal text, then plain two-decimal text."""
    return (f"CASE WHEN {n} IS NULL THEN CAST(array() AS ARRAY<STRING>) "
            f"ELSE array(format_number({n}, 2), format_string('%.2f', {n})) END")


def single_sql(s: str) -> str:
    return f"CASE WHEN {s} IS NULL OR {s} = '' THEN CAST(array() AS ARRAY<STRING>) ELSE array({s}) END"


def labels_sql(r: str = "record") -> str:
    """The nine labels of a record with their variants, as one array."""
    per_label = [single_sql(f"{r}.invoice_number.value"), word_fallbacks_sql(f"{r}.vendor.name"),
                 date_variants_sql(f"{r}.bill_date.value"), date_variants_sql(f"{r}.due_date.value"),
                 single_sql(f"{r}.po_number.value"), money_variants_sql(f"{r}.subtotal.value"),
                 money_variants_sql(f"{r}.tax.value"), money_variants_sql(f"{r}.total.value"),
                 single_sql(f"{r}.currency.value")]
    return "array(" + ", ".join(f"named_struct('label_no', {i}, 'label', {lit(lb)}, 'vs', {v})"
                                for i, (lb, v) in enumerate(zip(LABELS, per_label))) + ")"


def field_variants(records: DataFrame) -> DataFrame:
    """doc_id, labels: array of (label_no, label, vs)."""
    return records.selectExpr("doc_id", f"{labels_sql()} AS labels")


def lookup_within(docs: DataFrame) -> DataFrame:
    """J6 over one table (doc_id, text, labels): per (doc, label) the winning variant and the 0-based line it was found on;
    labels with no hit are absent."""
    # a variant is looked for only if no earlier one was found, and placed only if the text holds it
    place = "CASE WHEN char_length(v) >= 2 AND contains(lt, lower(v)) THEN instr(lt, lower(v)) ELSE 0 END"
    hit = (f"aggregate(transform(l.vs, v -> {js_trim('v')}), named_struct('no', -1, 'p', 0), (a, v) -> CASE WHEN a.p > 0 THEN a "
           f"ELSE named_struct('no', a.no + 1, 'p', coalesce({place}, 0)) END)")
    found = docs.selectExpr("doc_id", "lower(text) AS lt", "labels").selectExpr(
        "doc_id", "lt", f"inline(filter(transform(labels, l -> named_struct('label_no', l.label_no, 'label', l.label, 'm', {hit})), "
        "x -> x.m.p > 0))")
    return found.selectExpr("doc_id", "label_no", "label", "CAST(m.no AS BIGINT) AS variant_no",
                            "CAST(size(split(substr(lt, 1, m.p - 1), '\\n', -1)) - 1 AS BIGINT) AS line_no")


def lookup(variants: DataFrame, texts: DataFrame) -> DataFrame:
    """J6 for values and texts in two tables: one equi join on the document."""
    return lookup_within(variants.join(texts.select("doc_id", "text"), "doc_id"))


def normalise_box_sql(x: str, y: str, width: str, height: str, t2: str, t3: str, scale: str,
                      vw: str, vh: str) -> dict[str, str]:
    """box of a positioned text item on a rendered page, normalised to
    [0, 1]: width scaled with a 4-unit minimum, height at least the glyph
    size (hypot of the transform's skew/scale terms), y flipped to the top
    edge, then clamped. (x, y) are the item origin after the viewport
    transform."""
    w = f"greatest({width} * {scale}, 4D)"
    h = f"greatest({height} * {scale}, hypot({t2}, {t3}))"
    return {"x": f"greatest(0D, {x} / {vw})", "y": f"greatest(0D, ({y} - {h}) / {vh})",
            "w": f"least(1D, {w} / {vw})", "h": f"least(1D, {h} / {vh})"}


ITEM_SCHEMA = "ARRAY<STRUCT<str: STRING, width: DOUBLE, height: DOUBLE, transform: ARRAY<DOUBLE>>>"
PAGE_SCHEMA = "STRUCT<width: DOUBLE, height: DOUBLE, scale: DOUBLE, transform: ARRAY<DOUBLE>>"


#: Characters to search (text x variants) up to which variants are looked for one by one, and the character between two items.
_PLAIN_SEARCH, _GAP = 1 << 21, "\0"


def first_items(items: list[str | None], labels: list[list[str | None]]) -> list[tuple[int, int, int]]:
    """(label, variant, item) for each label that is found: its first variant (of two characters or more) that lies in an item, and
    the first such item."""
    return found_in(_GAP.join(x or "" for x in items), lambda: items, len(items), labels)


def found_in(joined: str | None, items, n: int, labels: list[list[str | None]]) -> list[tuple[int, int, int]]:
    """``first_items`` over ``n`` items joined by ``_GAP``, of which ``items()`` gives the list. A long document is read once for all
    variants, and so is one in which the gap may be part of a text."""
    if not joined:
        return []
    size = sum(map(len, labels))
    if len(joined) * size > _PLAIN_SEARCH or joined.count(_GAP) != n - 1:
        return _first_of_all(items(), labels)
    out = []
    for no, variants in enumerate(labels):
        for v, text in enumerate(variants):
            if text and len(text) >= 2:
                if _GAP in text:
                    return _first_of_all(items(), labels)
                at = joined.find(text)
                if at >= 0:
                    out.append((no, v, joined.count(_GAP, 0, at)))
                    break
    return out


def _first_of_all(items: list[str | None], labels: list[list[str | None]]) -> list[tuple[int, int, int]]:
    """All variants of all labels are looked for at once, in one pass over the items."""
    import ahocorasick
    wanted: dict[str, list[tuple[int, int]]] = {}
    for no, variants in enumerate(labels):
        for v, text in enumerate(variants):
            if text and len(text) >= 2:
                wanted.setdefault(text, []).append((no, v))
    if not wanted:
        return []
    found = ahocorasick.Automaton()
    for text in wanted:
        found.add_word(text, text)
    found.make_automaton()
    at: dict[str, int] = {}
    for i, item in enumerate(items):
        for _, text in found.iter(item) if item else ():
            at.setdefault(text, i)
        if len(at) == len(wanted):
            break
    best: dict[int, tuple[int, int]] = {}
    for text, i in at.items():
        for no, v in wanted[text]:
            if no not in best or v < best[no][0]:
                best[no] = (v, i)
    return [(no, *best[no]) for no in sorted(best)]


def _multiply(m: str, n: str) -> list[str]:
    """The six terms of the product of two 2-D transforms, as SQL."""
    a, b = ([f"{x}[{i}]" for i in range(6)] for x in (m, n))
    return [f"{a[0]} * {b[0]} + {a[2]} * {b[1]}", f"{a[1]} * {b[0]} + {a[3]} * {b[1]}", f"{a[0]} * {b[2]} + {a[2]} * {b[3]}",
            f"{a[1]} * {b[2]} + {a[3]} * {b[3]}", f"{a[0]} * {b[4]} + {a[2]} * {b[5]} + {a[4]}", f"{a[1]} * {b[4]} + {a[3]} * {b[5]} + {a[5]}"]


def evidence_boxes(docs: DataFrame) -> DataFrame:
    """J6 + F9: for every label of a document the item that shows its value, and the item's box on the page. ``docs`` has doc_id,
    labels (as ``field_variants``), items (``ITEM_SCHEMA``, in page order) and page (``PAGE_SCHEMA``). One row per label found; null
    items, texts or labels find nothing; a label with equal hits keeps the first variant, then the first item."""
    lowered = docs.select(
        "doc_id", F.col("items").cast(ITEM_SCHEMA).alias("items"), F.col("page").cast(PAGE_SCHEMA).alias("page"), "labels",
        F.expr("transform(items, i -> lower(i.str))").alias("texts"),
        F.expr(f"transform(labels, l -> transform(l.vs, v -> lower({js_trim('v')})))").alias("variants"))
    kinds = {f.name: f.dataType for f in lowered.schema.fields}
    label = kinds["labels"].elementType
    out = T.StructType([T.StructField("doc_id", kinds["doc_id"]), T.StructField("label_no", label["label_no"].dataType),
                        T.StructField("label", label["label"].dataType), T.StructField("variant_no", T.IntegerType()),
                        T.StructField("item_no", T.IntegerType()), T.StructField("it", kinds["items"].elementType), T.StructField("page", kinds["page"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels, items = (b.column(c) for c in ("texts", "labels", "items"))
            plain = pa.ListArray.from_arrays(texts.offsets, pc.fill_null(texts.values, ""))
            joined = pc.binary_join(plain, _GAP).to_pylist()
            size = pc.list_value_length(texts).to_pylist()
            hits = [(row, *hit) for row, (text, n, v) in enumerate(zip(joined, size, b.column("variants").to_pylist())) if n
                    for hit in found_in(text, lambda: texts[row].as_py(), n, [x or [] for x in v or []])]
            row, no, variant, item = (pa.array(c, pa.int32()) for c in (zip(*hits) if hits else [()] * 4))
            of = labels.values.take(pc.add(labels.offsets.take(row), no))
            it = items.values.take(pc.add(items.offsets.take(row), item))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), pc.struct_field(of, "label_no"), pc.struct_field(of, "label"),
                                              variant, item, it, b.column("page").take(row)], names=out.names)
    one = lowered.mapInArrow(run, out)
    tx = _multiply("page.transform", "it.transform")
    placed = one.selectExpr("*", *[f"{tx[i]} AS t{i}" for i in (2, 3, 4, 5)])
    box = normalise_box_sql("t4", "t5", "it.width", "it.height", "t2", "t3", "page.scale", "page.width", "page.height")
    return placed.selectExpr("doc_id", "label_no", "label", "variant_no", "item_no", *[f"{v} AS {k}" for k, v in box.items()])
