"""Custom fields: definition check (P5), schema extension (P6), value x
definition join (J5), display projection (P7), prompt block (P13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schemas as S
from ledgerlens.functions.sql import js_trim

# Limits of a definition list.
MAX_FIELDS, ID_MAX, NAME_MIN, NAME_MAX, DESC_MIN, DESC_MAX = 10, 64, 1, 30, 5, 200
TYPES = ("string", "number", "date")
DEF_SCHEMA = "ARRAY<STRUCT<id: STRING, name: STRING, type: STRING, description: STRING>>"

# The prompt text around the document.
PROMPT_INSTRUCTION = "Extract the invoice data per the schema."
CUSTOM_BLOCK_HEAD = ('\n\nAdditionally, extract these user-defined custom fields. Place them under '
                     '"custom_fields" in the response, keyed exactly by the IDs below. Each value uses '
                     'the same {value, confidence, reasoning} shape as the standard fields:\n')


def check_definitions_sql(json_col: str) -> dict[str, str]:
    """P5: the JSON array parses, has at most 10 entries, and every entry
    has id 1..64, name 1..30, a known type and description 5..200 chars, all
    of them JSON strings (a number is not taken for text); otherwise the
    whole list is rejected."""
    v = f"try_parse_json({json_col})"
    is_list = f"coalesce(schema_of_variant({v}) LIKE 'ARRAY%', false)"
    entries = f"try_variant_get({v}, '$', 'array<variant>')"

    def text(key: str) -> str:
        return (f"CASE WHEN schema_of_variant(try_variant_get(d, '$.{key}', 'variant')) = 'STRING' "
                f"THEN try_variant_get(d, '$.{key}', 'string') END")
    types = ", ".join(f"'{t}'" for t in TYPES)
    entry_ok = (f"d -> coalesce(char_length({text('id')}) BETWEEN 1 AND {ID_MAX} "
                f"AND char_length({text('name')}) BETWEEN {NAME_MIN} AND {NAME_MAX} AND {text('type')} IN ({types}) "
                f"AND char_length({text('description')}) BETWEEN {DESC_MIN} AND {DESC_MAX}, false)")
    defs = f"CASE WHEN {is_list} THEN from_json({json_col}, '{DEF_SCHEMA}') END"
    reason = (f"CASE WHEN NOT {is_list} THEN 'non-array' WHEN size({entries}) > {MAX_FIELDS} THEN 'too-many' "
              f"WHEN NOT forall({entries}, {entry_ok}) THEN 'invalid-entry' END")
    return {"defs": defs, "reason": reason}


def check_definitions(df: DataFrame, json_col: str) -> DataFrame:
    """P5 as columns ``defs`` and ``reason``, as ``check_definitions_sql`` gives them; each list is parsed once and each entry
    taken apart once."""
    def text(key: str) -> str:
        return (f"CASE WHEN schema_of_variant(try_variant_get(d, '$.{key}', 'variant')) = 'STRING' "
                f"THEN try_variant_get(d, '$.{key}', 'string') END")
    entry = ", ".join(f"'{k}', {text(k)}" for k in ("id", "name", "type", "description"))
    types = ", ".join(f"'{t}'" for t in TYPES)
    fine = (f"d -> coalesce(char_length(d.id) BETWEEN 1 AND {ID_MAX} AND char_length(d.name) BETWEEN {NAME_MIN} AND {NAME_MAX} "
            f"AND d.type IN ({types}) AND char_length(d.description) BETWEEN {DESC_MIN} AND {DESC_MAX}, false)")
    out = df.selectExpr("*", f"try_parse_json({json_col}) AS _v").selectExpr(
        "*", "coalesce(schema_of_variant(_v) LIKE 'ARRAY%', false) AS _list").selectExpr(
        "*", f"CASE WHEN _list THEN transform(try_variant_get(_v, '$', 'array<variant>'), d -> named_struct({entry})) END AS _checked")
    return out.selectExpr(
        *df.columns, f"CASE WHEN _list THEN from_json({json_col}, '{DEF_SCHEMA}') END AS defs",
        f"CASE WHEN NOT _list THEN 'non-array' WHEN size(_checked) > {MAX_FIELDS} THEN 'too-many' "
        f"WHEN NOT forall(_checked, {fine}) THEN 'invalid-entry' END AS reason")


def extraction_schema(definitions: list[dict]) -> T.StructType:
    """The record schema extended with ``custom_fields`` (number ->
    double, string/date -> string). Built on the driver from the (at most
    10) definitions of one request."""
    if not definitions:
        return S.RECORD
    fields = [T.StructField(d["id"], S.field_struct(T.DoubleType() if d["type"] == "number"
                                                    else T.StringType()), True) for d in definitions]
    return T.StructType(S.RECORD.fields + [T.StructField("custom_fields", T.StructType(fields), True)])


#: The confidences that a field may have.
CONFIDENCES = ("high", "medium", "low")


def _field_reason(f: str, kind: str) -> str:
    """Why a custom field's variant ``f`` is rejected, first reason first; null if it is good. ``kind`` is the definition's type."""
    part = {k: f"schema_of_variant(try_variant_get({f}, '$.{k}', 'variant'))" for k in ("value", "confidence", "reasoning")}
    number = f"{part['value']} RLIKE '^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$'"
    right = f"CASE WHEN {kind} = 'number' THEN {number} ELSE {part['value']} = 'STRING' END"
    wrong = (f"NOT schema_of_variant({f}) LIKE 'OBJECT%' OR NOT ({part['value']} = 'VOID' OR {right}) "
             f"OR {part['confidence']} <> 'STRING' OR {part['reasoning']} <> 'STRING'")
    absent = " OR ".join(f"{p} IS NULL" for p in part.values())
    known = ", ".join(f"'{c}'" for c in CONFIDENCES)
    return (f"CASE WHEN {f} IS NULL THEN 'missing-key' WHEN coalesce({wrong}, false) THEN 'wrong-type' WHEN {absent} THEN 'missing-key' "
            f"WHEN try_variant_get({f}, '$.confidence', 'string') NOT IN ({known}) THEN 'bad-enum' END")


def typed_values(responses: DataFrame, defs: DataFrame, text_col: str = "response") -> DataFrame:
    """P6 + U1: custom fields read from JSON responses (doc_id, tenant, text) by the types of their tenant's definitions (tenant, pos,
    id, type). One row per document and definition: ``number_value`` of a number, ``text_value`` of a string or date, and ``reason`` why a
    field is rejected (``invalid-json``, ``wrong-type``, ``missing-key``, ``bad-enum``), which leaves it without a value. Kinds are read from
    the JSON itself; a null value is good. A document whose tenant has no definitions has no rows."""
    parsed = responses.selectExpr("doc_id", "tenant", f"try_parse_json({text_col}) AS _v").selectExpr(
        "doc_id", "tenant", "_v IS NOT NULL AS _json", "try_variant_get(_v, '$.custom_fields', 'map<string,variant>') AS _m")
    field = parsed.join(defs.select("tenant", "pos", "id", "type"), "tenant").selectExpr(
        "doc_id", "tenant", "pos", "id", "type", "_json", "try_element_at(_m, id) AS _f")
    checked = field.selectExpr("*", f"CASE WHEN NOT _json THEN 'invalid-json' ELSE {_field_reason('_f', 'type')} END AS reason")
    return checked.selectExpr(
        "doc_id", "tenant", "pos", "id", "type",
        "CASE WHEN reason IS NULL AND type = 'number' THEN try_variant_get(_f, '$.value', 'double') END AS number_value",
        "CASE WHEN reason IS NULL AND type <> 'number' THEN try_variant_get(_f, '$.value', 'string') END AS text_value",
        "CASE WHEN reason IS NULL THEN try_variant_get(_f, '$.confidence', 'string') END AS confidence", "reason")


def read_extractions(df: DataFrame, definitions: list[dict], text_col: str = "value") -> DataFrame:
    """P6 for one tenant (10 definitions at most): ``record`` by the extended schema of ``extraction_schema``, its ``custom_fields`` typed;
    ``error`` as in the S6 source, or the first reason of a custom field. A rejected response has no record."""
    from ledgerlens.sources.records import parse_records
    base = parse_records(df, text_col).drop("record")
    if not definitions:
        return parse_records(df, text_col)
    staged = base.selectExpr("*", f"try_variant_get(try_parse_json({text_col}), '$.custom_fields', 'map<string,variant>') AS _m")
    reasons = []
    for i, d in enumerate(definitions):
        staged = staged.withColumn(f"_f{i}", F.expr("try_element_at(_m, {})".format("'" + d["id"].replace("\\", "\\\\").replace("'", "\\'") + "'")))
        reasons.append(_field_reason(f"_f{i}", f"'{d['type']}'"))
    kept = [c for c in base.columns if c != "error"]
    out = staged.selectExpr(*kept, f"coalesce(error, {', '.join(reasons)}) AS error")
    schema = extraction_schema(definitions)
    return out.withColumn("record", F.when(F.col("error").isNull(), F.from_json(F.col(text_col), schema)))


def custom_block_sql(defs: str) -> str:
    """One line per definition after the fixed lead-in; '' when none."""
    line = (f"d -> concat('- ID \"', d.id, '\" (', d.type, ', displayed as \"', {js_trim('d.name')}, "
            f"'\"): ', {js_trim('d.description')})")
    head = CUSTOM_BLOCK_HEAD.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return (f"CASE WHEN {defs} IS NULL OR size({defs}) = 0 THEN '' "
            f"ELSE concat('{head}', array_join(transform({defs}, {line}), '\\n')) END")


def prompt_sql(text: str, today: str, block: str) -> str:
    return (f"concat('<today>', {today}, '</today>\\n<invoice_text>\\n', {text}, "
            f"'\\n</invoice_text>\\n\\n{PROMPT_INSTRUCTION}', {block})")


# What is asked about a document that is sent as an image or as a scanned PDF.
IMAGE_INSTRUCTION = (
    'The image above is an invoice. Extract the invoice data per the schema. For every reasoning string, prefix it with '
    '"[bbox: x, y, w, h] " where x, y, w, h are normalized 0..1 coordinates of the region in the image (e.g., "[bbox: 0.7, 0.05, 0.25, 0.06] '
    'Invoice number labeled at top-right..."). If you can\'t localize visually, prefix with "[bbox: none] ".')
PDF_INSTRUCTION = (
    'The document above is a scanned (image-only) invoice PDF. Extract the invoice data per the schema. For every reasoning string, prefix it '
    'with "[bbox: x, y, w, h] " where x, y, w, h are normalized 0..1 coordinates of the region on the FIRST page of the document (the rendered '
    'preview shows page 1 only). If the value doesn\'t appear on page 1, or you can\'t localize visually, prefix with "[bbox: none] ".')


def prompt_parts_sql(kind: str, text: str, mime: str, content: str, today: str, block: str) -> str:
    """P13 for every input kind: the parts of a prompt as an array of (type, media_type, data, text). ``kind`` is text, image or pdf
    (others give null); files travel as base64 without line breaks."""
    from ledgerlens.functions.sql import lit
    data = f"regexp_replace(base64({content}), '[\\\\r\\\\n]', '')"

    def part(t: str, m: str, d: str, x: str) -> str:
        return f"named_struct('type', '{t}', 'media_type', CAST({m} AS STRING), 'data', CAST({d} AS STRING), 'text', CAST({x} AS STRING))"

    def asked(instruction: str) -> str:
        return part("text", "NULL", "NULL", f"concat('<today>', {today}, '</today>\\n\\n', {lit(instruction)}, {block})")
    return (f"CASE {kind} WHEN 'text' THEN array({part('text', 'NULL', 'NULL', prompt_sql(text, today, block))}) "
            f"WHEN 'image' THEN array({part('image', mime, data, 'NULL')}, {asked(IMAGE_INSTRUCTION)}) "
            f"WHEN 'pdf' THEN array({part('document', chr(39) + 'application/pdf' + chr(39), data, 'NULL')}, {asked(PDF_INSTRUCTION)}) END")


def value_map(values: DataFrame) -> DataFrame:
    """One MAP id -> value per document (at most ``MAX_FIELDS`` entries; null values are kept)."""
    return values.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "value"))).alias("custom_fields"))


def display_values(defs: DataFrame, values: DataFrame) -> DataFrame:
    """J5 + P7: definitions (tenant, pos, id, name) joined with extracted
    values (doc_id, tenant, id, value) by (tenant, id); a field without a
    value row is absent and skipped, one whose value is null is shown; label = trimmed name, or the id when that is empty."""
    return (values.join(definition_arrays(defs, "id", "pos", "name"), "tenant")
            .selectExpr("doc_id", "value", "inline(filter(ds, d -> d.id = id))")
            .selectExpr("doc_id", "pos", f"coalesce(nullif({js_trim('name')}, ''), id) AS label", "value"))


def definition_arrays(defs: DataFrame, *cols: str) -> DataFrame:
    """One row per tenant: its definitions (at most ``MAX_FIELDS``) as an array, so that values meet them by the tenant alone and
    need not travel again for the id."""
    return defs.groupBy("tenant").agg(F.collect_list(F.struct(*cols)).alias("ds"))
