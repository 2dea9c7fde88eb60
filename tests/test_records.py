import json

import pytest

from ledgerlens.operators.chunks import record_json_sql
from ledgerlens.sources.records import parse_records, split_records
from tests.util import item, record, records_df


@pytest.fixture
def text(spark):
    return records_df(spark, [record(items=[item()], flags=[{"severity": "info", "message": "m"}])]).selectExpr(
        f"{record_json_sql()} AS v").first()["v"]


def _change(text, path, value):
    """The text with one value replaced, or taken away (value = ...)."""
    obj = json.loads(text)
    at = obj
    for k in path[:-1]:
        at = at[k]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(obj)


def test_every_fault_is_named(spark, text):
    cases = [
        (("flags", 0, "severity"), None, "wrong-type"), (("flags", 0, "severity"), ..., "missing-key"), (("flags", 0, "message"), None, "wrong-type"),
        (("flags", 0, "severity"), "fatal", "bad-enum"), (("invoice_number", "value"), 5, "wrong-type"), (("invoice_number", "value"), ..., "missing-key"),
        (("invoice_number", "reasoning"), ..., "missing-key"), (("line_items", 0, "amount"), ..., "missing-key"), (("line_items", 0, "amount"), "5", "wrong-type"),
        (("total", "value"), "12", "wrong-type"), (("total", "value"), True, "wrong-type"), (("vendor",), None, "wrong-type"), (("vendor",), ..., "missing-key"),
        (("vendor", "confidence"), "sure", "bad-enum"), (("tax", "confidence"), None, "wrong-type"), (("line_items",), {}, "wrong-type"),
        (("flags",), ..., "missing-key"), (("flags", 0), "x", "wrong-type"), (("line_items", 0, "reasoning"), 5, "wrong-type"),
        (("line_items", 0, "reasoning"), ..., None), (("invoice_number", "value"), None, None), (("total", "value"), 1e300, None), (("extra",), [1], None),
        (("line_items", 0, "quantity"), None, None), (("line_items",), [], None),
    ]
    rows = [(i, _change(text, path, value)) for i, (path, value, _) in enumerate(cases)]
    rows += [(100, "{not json"), (101, "[1, 2]"), (102, ""), (103, None), (104, "null"), (105, '{"invoice_number": 5}')]
    got = {r["i"]: r for r in parse_records(spark.createDataFrame(rows, "i int, value string"), "value").collect()}
    for i, (path, value, want) in enumerate(cases):
        assert got[i]["error"] == want, (path, value)
        assert (got[i]["record"] is None) == (want is not None)
    assert [got[i]["error"] for i in range(100, 106)] == ["invalid-json", "wrong-type", "invalid-json", "invalid-json", "wrong-type", "wrong-type"]


def test_split_and_values(spark, text):
    good, dead = split_records(spark.createDataFrame([(text,), ("{",)], "value string"))
    r = good.first()["record"]
    assert r["invoice_number"]["value"] == "INV-1" and r["line_items"][0]["amount"] == 10.0
    assert [x["error"] for x in dead.collect()] == ["invalid-json"]


def test_control_characters_round_trip(spark):
    odd = "".join(map(chr, range(1, 32))) + "\x00\"\\/é\u2028"
    df = records_df(spark, [record(vendor=odd, items=[item(description="a\nb\tc")])]).selectExpr(f"{record_json_sql()} AS value")
    v = df.first()["value"]
    assert json.loads(v)["vendor"]["name"] == odd and json.loads(v)["line_items"][0]["description"] == "a\nb\tc"
    assert json.dumps(odd, ensure_ascii=False) in v
    assert parse_records(df).first()["record"]["vendor"]["name"] == odd


def test_a_record_that_only_looks_whole_is_taken_apart(spark):
    good = record(items=[{"description": "a", "quantity": 1.0, "unit_price": 2.0, "amount": 2.0, "reasoning": "r"}], flags=[])
    hidden = {k: v for k, v in good.items() if k not in ("invoice_number", "line_items")}
    spoof = dict(hidden, flags=[{"message": "m", "severity": "info", "invoice_number": good["invoice_number"], "line_items": []}])
    loose = dict(good, line_items=[*good["line_items"], {"description": "b"}])        # the merged kinds of a list hide a missing key
    null = dict(good, line_items=[None])
    quoted = dict(good, **{"vendor: OBJECT<": 1})
    mark = dict(good, flags=[{"message": "m", "severity": "fatal"}])
    cases = [(good, None), (spoof, "missing-key"), (loose, "missing-key"), (null, "wrong-type"), (quoted, None), (mark, "bad-enum"),
             (dict(good, total=dict(good["total"], value=None)), None), (dict(good, total=dict(good["total"], value="1")), "wrong-type")]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, value string")
    got = {r.i: r.error for r in parse_records(rows).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}


def test_kinds_are_read_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = parse_records(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert 0 < plan.count("schemaOfVariant") < 80         # 108 when each condition read its kind again


def test_a_filter_holds_no_copy_of_the_checks(spark):
    for part in split_records(spark.createDataFrame([("{}",)], "value string")):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter" in line]
        assert filters and all(len(line) < 400 for line in filters)
