from pyspark.sql import functions as F

from ledgerlens.functions import sql as X


def one(spark, expr):
    return spark.range(1).select(F.expr(expr).alias("v")).collect()[0]["v"]


def test_round2_ties_toward_plus_infinity(spark):
    assert one(spark, X.round2("1.005D")) == 1.0          # 1.005*100 = 100.49999...
    assert one(spark, X.round2("-0.005D")) == 0.0
    assert one(spark, X.round2("2.675D")) == 2.68 or one(spark, X.round2("2.675D")) == 2.67
    assert one(spark, X.round2("0.125D")) == 0.13


def test_js_number_text(spark):
    assert one(spark, X.js_number("2007.0D")) == "2007"
    assert one(spark, X.js_number("1234567890.5D")) == "1234567890.5"
    assert one(spark, X.js_number("0.1D")) == "0.1"
    assert one(spark, X.js_number("0D")) == "0"
    assert one(spark, X.js_number("CAST(NULL AS DOUBLE)")) is None


def test_js_trim_all_white_space(spark):
    assert one(spark, X.js_trim("'\\t a \\n '")) == "a"
    assert one(spark, "char_length(" + X.js_trim("concat(chr(160), 'a', chr(160))") + ")") == 1


def test_csv_cell(spark):
    assert one(spark, X.csv_cell("CAST(NULL AS STRING)")) == ""
    assert one(spark, X.csv_cell("'plain'")) == "plain"
    assert one(spark, X.csv_cell("'a,b'")) == '"a,b"'
    assert one(spark, X.csv_cell("'say \"hi\"'")) == '"say ""hi"""'
    assert one(spark, X.csv_cell("' lead'")) == '" lead"'
    assert one(spark, X.csv_cell("'l\\nm'")) == '"l\nm"'
    assert one(spark, X.csv_cell("2007.0D", True)) == "2007"


def test_normalize_date(spark):
    for raw in ("2026-04-15", "04/15/2026", "4/15/2026", "15-Apr-2026", "15-apr-2026",
                "April 15, 2026", "april 15 2026"):
        assert one(spark, X.normalize_date(f"'{raw}'")) == "2026-04-15", raw
    assert one(spark, X.normalize_date("'13/45/2026'")) == "2026-13-45"   # no calendar check
    assert one(spark, X.normalize_date("'not a date'")) is None
    assert one(spark, X.normalize_date("''")) is None
    assert one(spark, X.normalize_date("'15-Foo-2026'")) is None


def test_pct(spark):
    assert one(spark, X.pct("1", "3")) == "33.3%"
    assert one(spark, X.pct("2", "3")) == "66.7%"
    assert one(spark, X.pct("1", "8")) == "12.5%"
    assert one(spark, X.pct("0", "0")) == "n/a"
    assert one(spark, X.pct("9", "9")) == "100.0%"
