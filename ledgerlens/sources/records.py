"""Validated JSON record source with dead letters (S6) and the structured
log source (S8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlens import schemas as S

_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def _kind(v: str, path: str) -> str:
    """Type name of a JSON value at a path: ``VOID`` for null, SQL null where the path is absent."""
    return f"schema_of_variant(try_variant_get({v}, '$.{path}', 'variant'))"


def _enum(values: tuple) -> str:
    return ", ".join(f"'{x}'" for x in values)


def _checks(v: str, paths: dict[str, str], kinds: dict[str, str]) -> dict[str, list[str]]:
    """Conditions under which an object is rejected, by reason. ``paths``: path -> ``text``, ``text?`` or ``number?``
    (null allowed), ``confidence``, ``severity`` or ``text-`` (may be absent); ``kinds``: path -> column with its kind."""
    missing, wrong, outside = [], [], []
    for path, want in paths.items():
        kind = kinds[path]
        ok = f"{kind} RLIKE '{_NUMBER}'" if want.startswith("number") else f"{kind} = 'STRING'"
        if want.endswith("?"):
            ok = f"({ok} OR {kind} = 'VOID')"
        if want != "text-":
            missing.append(f"{kind} IS NULL")
        wrong.append(f"NOT coalesce({ok}, true)")
        if want in ("confidence", "severity"):
            allowed = S.CONFIDENCES if want == "confidence" else S.SEVERITIES
            outside.append(f"NOT coalesce(try_variant_get({v}, '$.{path}', 'string') IN ({_enum(allowed)}), true)")
    return {"missing-key": missing, "wrong-type": wrong, "bad-enum": outside}


def _header() -> dict[str, str]:
    out = {}
    for f in S.STRING_FIELDS + S.NUMBER_FIELDS:
        out |= {f"{f}.value": "number?" if f in S.NUMBER_FIELDS else "text?", f"{f}.confidence": "confidence", f"{f}.reasoning": "text"}
    return out | {"vendor.name": "text?", "vendor.address": "text?", "vendor.confidence": "confidence", "vendor.reasoning": "text"}


def _plain_kinds() -> tuple[str, str, str]:
    """The kinds of a record's header, of an item and of a flag that have nothing wrong or missing, as patterns over
    ``schema_of_variant``: keys are in order there and one that isn't plain letters is quoted, and a list's part is balanced, so no other value reads
    the same."""
    number = r"(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\\(\\d+,\\s?\\d+\\))"
    kind = {"text": "STRING", "text?": "(?:STRING|VOID)", "number?": f"(?:{number}|VOID)", "confidence": "STRING", "severity": "STRING"}

    def entry(want: dict[str, str]) -> str:
        parts = [f"{k}: {kind[w]}, " if w != "text-" else f"(?:{k}: STRING, )?" for k, w in sorted(want.items())]
        return "OBJECT<" + "".join(parts).removesuffix(", ") + ">"
    tops: dict[str, dict[str, str]] = {}
    for path, want in _header().items():
        top, key = path.split(".")
        tops.setdefault(top, {})[key] = want
    balanced = "[^<>`]*+"
    for _ in range(3):
        balanced = f"(?:[^<>`]++|<{balanced}>)*+"
    shown = {k: entry(v) for k, v in tops.items()} | {k: f"ARRAY<{balanced}>" for k in ("line_items", "flags")}
    record = "OBJECT<" + ", ".join(f"{k}: {v}" for k, v in sorted(shown.items())) + ">"
    return tuple(f"^{x}$" for x in (record, entry(_ITEM), entry(_FLAG)))


_ITEM = {"description": "text?", "quantity": "number?", "unit_price": "number?", "amount": "number?", "reasoning": "text-"}
_FLAG = {"severity": "severity", "message": "text"}


def parse_records(df: DataFrame, text_col: str = "value") -> DataFrame:
    """Parse JSON text to ``record``; ``error`` says why a row is rejected, first reason first: ``invalid-json``;
    ``wrong-type`` (the text, a field or a list entry is of another kind than the schema's, null included where the schema has
    none); ``missing-key`` (a required key is absent, at any depth); ``bad-enum``. Kinds are read from the JSON itself, so
    nothing is coerced or filled in. Unknown keys are dropped; an item's reasoning may be absent."""
    p = df.selectExpr("*", f"try_parse_json({text_col}) AS _v")
    lists = {k: f"try_variant_get(_v, '$.{k}', 'array<variant>')" for k in ("line_items", "flags")}
    tops = [f for f in (*S.STRING_FIELDS, *S.NUMBER_FIELDS, "vendor")]
    # each kind is read once, as a column or (in lists) a field of an entry's struct; the conditions only compare these. A header or list that
    # shows by one look at its kinds that it is as it should be is not taken apart
    kinds = {path: f"_k{i}" for i, path in enumerate([*tops, *lists, *_header()])}
    usual = {**dict.fromkeys(tops, "OBJECT"), **dict.fromkeys(lists, "ARRAY"),
             **{path: "DOUBLE" if want.startswith("number") else "STRING" for path, want in _header().items()}}
    entries = {k: {path: f"x.k{i}" for i, path in enumerate(want)} for k, want in (("line_items", _ITEM), ("flags", _FLAG))}

    def entry(k: str, plain: str) -> str:
        fields = ", ".join(f"'{col[2:]}', {_kind('x', path)}" for path, col in entries[k].items())
        return (f"CASE WHEN NOT forall(_{k}, x -> schema_of_variant(x) RLIKE '{plain}') "
                f"THEN transform(_{k}, x -> named_struct('v', x, 'kind', schema_of_variant(x), {fields})) END AS _{k}_kinds")
    record, *each = _plain_kinds()
    p = p.selectExpr("*", "schema_of_variant(_v) AS _kind", *[f"{x} AS _{k}" for k, x in lists.items()])
    p = p.selectExpr("*", f"coalesce(_kind RLIKE '{record}', false) AS _plain", *[entry(k, x) for k, x in zip(lists, each)])
    p = p.selectExpr("*", *[f"CASE WHEN _plain THEN '{usual[path]}' ELSE {_kind('_v', path)} END AS {col}" for path, col in kinds.items()])
    head = _checks("_v", _header(), kinds)
    item, flag = (_checks("x.v", want, entries[k]) for k, want in (("line_items", _ITEM), ("flags", _FLAG)))
    outside = [f"exists(_flags, x -> {c})" for c in _checks("x", _FLAG, entries["flags"])["bad-enum"]]

    def any_of(reason: str) -> str:
        inside = outside if reason == "bad-enum" else [
            f"exists(_{k}_kinds, x -> {' OR '.join(c[reason])})" for k, c in (("line_items", item), ("flags", flag)) if c[reason]]
        return "coalesce(" + " OR ".join(f"({x})" for x in [*head[reason], *inside]) + ", false)"
    shape = " OR ".join([f"NOT coalesce({kinds[f]} LIKE 'OBJECT%', true)" for f in tops]
                        + [f"NOT coalesce({kinds[k]} LIKE 'ARRAY%', true)" for k in lists]
                        + [f"exists(_{k}_kinds, x -> NOT x.kind LIKE 'OBJECT%')" for k in lists])
    absent = " OR ".join(f"{kinds[f]} IS NULL" for f in (*tops, *lists))
    err = (f"CASE WHEN _v IS NULL THEN 'invalid-json' WHEN _kind NOT LIKE 'OBJECT%' OR coalesce({shape}, false) OR {any_of('wrong-type')} THEN 'wrong-type' "
           f"WHEN {absent} OR {any_of('missing-key')} THEN 'missing-key' WHEN {any_of('bad-enum')} THEN 'bad-enum' END")
    return p.selectExpr(*df.columns, f"{err} AS error").selectExpr(
        *df.columns, f"CASE WHEN error IS NULL THEN from_json({text_col}, '{S.RECORD.simpleString()}') END AS record", "error")


def checked_once(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed rows that are good, and those that are not. The filters take ``error`` as it was computed: beside a column that
    isn't deterministic they are not moved below the checks, which would put a copy of all checks into each filter."""
    p = parsed.selectExpr("*", "rand() AS _row")
    return (p.filter("error IS NULL AND _row >= 0").drop("error", "_row"), p.filter("error IS NOT NULL AND _row >= 0").drop("_row"))


def split_records(df: DataFrame, text_col: str = "value") -> tuple[DataFrame, DataFrame]:
    good, dead = checked_once(parse_records(df, text_col))
    return good, dead.select(text_col, "error")


# The keys a structured log line may carry (besides ts, level,
# correlation_id); an explicit schema is the allowlist.
LOG_KEYS = (("category", T.StringType()), ("pdf_size_bytes", T.LongType()), ("pdf_num_pages", T.IntegerType()),
            ("pdf_mime", T.StringType()), ("pdf_source", T.StringType()), ("duration_ms", T.LongType()),
            ("error_code", T.StringType()), ("retry_count", T.IntegerType()), ("http_status", T.IntegerType()),
            ("cost_usd", T.DoubleType()), ("monthly_cost_usd", T.DoubleType()), ("budget_cap_usd", T.DoubleType()),
            ("rate_limit_remaining", T.IntegerType()), ("route", T.StringType()), ("note", T.StringType()))
LOG_SCHEMA = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("level", T.StringType()),
                           T.StructField("correlation_id", T.StringType())]
                          + [T.StructField(n, t) for n, t in LOG_KEYS])


def read_logs(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON log lines with the allowlisted keys only."""
    r = spark.readStream if streaming else spark.read
    return r.schema(LOG_SCHEMA).json(path)
