"""Findings of round 3: what travels, is sorted or is computed again must not grow faster than the input."""
import random

from ledgerlens.operators import chunks as CH
from ledgerlens.operators import custom_fields as CF
from ledgerlens.operators import evidence as EV
from ledgerlens.plans.registry import queries
from ledgerlens.sources.invoices import build_invoice_records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_are_not_gathered_before_they_travel(spark, sf_small):
    """no broadcast that a larger table loses, and no partial aggregate below the items' exchange."""
    shown = plan(build_invoice_records(spark, sf_small))
    assert "Broadcast" not in shown
    below = shown[shown.rindex("collect_list(it"):]
    assert "Exchange hashpartitioning(k" in below, shown


def test_chunks_travel_as_pieces_in_any_order(spark):
    """consecutive chunks are one row before the exchange; shuffled, repeated, empty and null chunks give the same text."""
    rows, want = [], {}
    rnd = random.Random(5)
    for r in range(40):
        parts = ["".join(rnd.choice("abß€𝄞\n") for _ in range(rnd.randrange(5))) for _ in range(rnd.randrange(1, 30))]
        mine = [(f"R{r}", i, None if not p and i % 2 else p) for i, p in enumerate(parts)]
        mine += [mine[0]] if r % 3 == 0 else []
        if r % 2:
            rnd.shuffle(mine)
        rows += mine
        ordered = sorted((i, p or "") for _, i, p in mine)
        want[f"R{r}"] = ("".join(p for _, p in ordered), [i for i, _ in ordered], [len(p) for _, p in ordered])
    df = spark.createDataFrame(rows, "response_id string, seq bigint, chunk string").coalesce(1)
    assert {r[0]: tuple(r[1:]) for r in CH.gathered(df).collect()} == want
    one = spark.range(1000).selectExpr("'R' AS response_id", "id AS seq", "'x' AS chunk").coalesce(1)
    sent = list(CH._pieces(iter(one.toArrow().to_batches())))
    assert sum(b.num_rows for b in sent) == 1


def test_rules_are_computed_once_per_record(spark, sf_small):
    """no filter with a copy of the rules below the explode."""
    for name in ("merged_flags", "validation_flags"):
        shown = queries()[name](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
        assert shown.count("is before bill date") == 1, name


def test_values_travel_once_to_their_tenant(spark):
    """F8: values meet the definitions by the tenant alone; an id that is listed twice is shown twice."""
    defs = spark.createDataFrame([("t", 0, "a", " A "), ("t", 1, "b", " "), ("t", 2, "a", "C"), ("u", 0, "a", "U")],
                                 "tenant string, pos int, id string, name string")
    values = spark.createDataFrame([("d", "t", "a", "1"), ("d", "t", "b", None), ("d", "t", "z", "9")],
                                   "doc_id string, tenant string, id string, value string")
    got = CF.display_values(defs, values)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("d", 0, "A", "1"), ("d", 1, "b", None), ("d", 2, "C", "1")], key=str)
    assert "id#" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("\n")[0]


def test_responses_need_no_row_for_each_field(spark, sf_small):
    """one gathering by tenant, none by document."""
    shown = queries()["custom_field_records"](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [doc_id" not in shown


def test_plain_and_automaton_search_agree():
    """variants looked for one by one give what one pass over the items gives, also with the gap inside a text."""
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ab\0c") for _ in range(rnd.randrange(n)))     # noqa: E731
    for _ in range(400):
        items = [word(8) if rnd.random() < .9 else None for _ in range(rnd.randrange(6))]
        labels = [[word(4) if rnd.random() < .9 else None for _ in range(rnd.randrange(4))] for _ in range(3)]
        assert EV.first_items(items, labels) == EV._first_of_all(items, labels)


def test_plain_amounts_equal_the_format(spark):
    """two decimals by way of a decimal are those of a format, also on halves."""
    from ledgerlens.functions.sql import fixed2
    x = "CASE id % 4 WHEN 0 THEN (id * 7919 % 100000000) / 1000D WHEN 1 THEN rand(3) * 1e6 WHEN 2 THEN (id % 1000) + 0.005D ELSE -rand(4) END"
    df = spark.range(200000).selectExpr(f"{x} AS x")
    assert df.where(f"{fixed2('x')} <> format_string('%.2f', x)").count() == 0


def test_the_view_is_written_small(spark, sf_small):
    """the reasoning texts repeat; the view's files are written with zstd and hold the rows of its plan."""
    from ledgerlens.sources.invoices import invoice_records
    view = invoice_records(spark, sf_small)
    assert all(f.endswith(".zstd.parquet") for f in view.inputFiles())
    assert view.exceptAll(build_invoice_records(spark, sf_small)).isEmpty() and view.count() == 1500


def test_an_exported_document_travels_as_one_row(spark):
    """the lines of a document are one row of the move, and those of line_item_lines; documents with the same id stay whole."""
    import os
    import tempfile

    from pyspark.sql import functions as F

    from ledgerlens.operators import exports as X
    from tests.util import item, record, records_df
    rnd = random.Random(9)
    text = lambda: rnd.choice([None, "", "a", " b", 'q"', "x,y", "l\r\nm", " z"])      # noqa: E731
    recs = [record(invoice_number=f"I{i}", vendor=text(),
                   items=[item(description=text(), quantity=rnd.choice([None, 2.0, 1e-7, 1e21]), amount=rnd.choice([None, -0.5, 3.25]))
                          for _ in range(rnd.randrange(5))]) for i in range(40)]
    df = records_df(spark, recs).withColumn("doc_id", F.col("record.invoice_number.value"))
    df = df.union(df.limit(1).withColumn("record", F.lit(None).cast(df.schema["record"].dataType))
                  .withColumn("doc_id", F.lit("I99")))
    rows = X.line_item_lines(df).collect()
    want = {d: "\r\n".join(r["line"] for r in sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["item_pos"] or 0))
            for d in {r["doc_id"] for r in rows}}
    blocks = X.line_item_blocks(df).collect()
    assert len(blocks) == 41 and {r["doc_id"]: r["line"] for r in blocks} == want
    path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "out")
    twins = [record(invoice_number=n, items=[item(description=f"{n}{i}") for i in range(6)]) for n in "AB"]
    X.write_csv(records_df(spark, twins).withColumn("doc_id", F.lit("D")), path, "line_items")
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    lines = "".join(open(os.path.join(path, p), newline="").read() for p in parts).split("\r\n")
    assert lines[0] == X.header_line("line_items") and [x[0] for x in lines[1:-1]] in (list("A" * 6 + "B" * 6), list("B" * 6 + "A" * 6))


def test_a_number_cell_is_written_once(spark):
    """a number's text needs no quotes, so it is not looked through for them."""
    from ledgerlens.functions.sql import csv_cell
    x = "CASE id WHEN 0 THEN NULL WHEN 1 THEN -0.5D WHEN 2 THEN 1e21D WHEN 3 THEN double('NaN') WHEN 4 THEN double('-Infinity') WHEN 5 THEN 1e-7D ELSE 7D END"
    assert "RLIKE" not in csv_cell("x", True)
    got = [r[0] for r in spark.range(7).selectExpr(f"{x} AS x", "id").orderBy("id").selectExpr(csv_cell("x", True)).collect()]
    assert got == ["", "-0.5", "1.0E21", "NaN", "-Infinity", "0.0000001", "7"]
