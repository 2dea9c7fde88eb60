from pyspark.sql import functions as F

from ledgerlens.operators import errors as ER
from ledgerlens.operators import exports as X
from ledgerlens.operators import intake as IN


def test_taxonomy_complete_and_joined(spark):
    assert len(ER.ERROR_TAXONOMY) == 9 and len({c for c, _, _ in ER.ERROR_TAXONOMY}) == 9 == len(ER.ERROR_HELP)
    df = spark.createDataFrame([("rate-limited",), ("cost-budget-exceeded",), ("nope",)], "code string")
    got = {r["code"]: r["http_status"] for r in ER.describe_errors(df).collect()}
    assert got == {"rate-limited": 429, "cost-budget-exceeded": 429, "nope": None}


def test_pdf_outcome_map(spark):
    df = spark.createDataFrame([("empty_file",), ("not_a_pdf",), ("image_only",), ("parse_failed",)], "o string")
    got = [r[0] for r in df.select(F.expr(ER.pdf_error_code_sql("o"))).collect()]
    assert got == ["corrupt-PDF", "non-PDF", "not-an-invoice", "corrupt-PDF"]


def test_pdf_header_and_magic(spark):
    rows = [("a.pdf", "application/pdf", bytes(b"%PDF-1.7 x")), ("b.pdf", "application/pdf", b""),
            ("c.pdf", "", b"<html>"), ("d.bin", "application/octet-stream", b"\xff\xd8\xff\xe0x"),
            ("e.bin", "", b"RIFF\x00\x00\x00\x00WEBPx"), ("f.docx", "application/msword", b"PK\x03\x04"),
            ("g.jpg", "image/jpg", b"x" * (IN.MAX_IMAGE_BYTES + 1))]
    df = spark.createDataFrame(rows, "name string, declared_mime string, content binary").selectExpr(
        "*", "CAST(length(content) AS BIGINT) AS length")
    got = [(r["kind"], r["image_mime"], r["error_code"]) for r in IN.triage(df).orderBy("name").collect()]
    assert got == [("pdf", None, None), ("error", None, "corrupt-PDF"), ("error", None, "non-PDF"),
                   ("image", "image/jpeg", None), ("image", "image/webp", None), ("error", None, "non-PDF"),
                   ("error", "image/jpeg", "oversized-PDF")]


def test_preview_and_request_sizes(spark):
    r = spark.range(1).select(F.expr(X.preview_sql("repeat('x', 700)")).alias("p")).collect()[0]
    assert len(r["p"]) == 500
    df = spark.createDataFrame([("r1", "a")] * 3 + [("r2", "b")] * 101 + [("r3", None)],
                               "request_id string, record string")
    got = {r["request_id"]: r["error"] for r in X.check_request_sizes(df).collect()}
    assert got == {"r1": None, "r2": "too-many", "r3": "empty"}


def test_files_on_disk_feed_the_triage(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.bin").write_bytes(b"\xff\xd8\xff\xe0x")
    got = {r["name"]: (r["kind"], r["error_code"]) for r in IN.triage(IN.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": ("pdf", None), "b.bin": ("image", None)}


def test_routes(spark):
    rows = [("a.pdf", b"%PDF-1.7", "text", 3, False), ("b.pdf", b"%PDF-1.7", " \n\t", 2, False), ("c.pdf", b"%PDF-1.7", None, None, None),
            ("d.pdf", b"%PDF-1.7", "x", 2, True), ("e.pdf", b"", None, None, None), ("f.bin", b"\xff\xd8\xff\xe0x", None, 9, None)]
    df = spark.createDataFrame([(n, "", bytes(c), t, p, f) for n, c, t, p, f in rows],
                               "name string, declared_mime string, content binary, pdf_text string, pdf_pages int, pdf_failed boolean")
    got = [(r["input"], r["vision_used"], r["num_pages"], r["error_code"], r["outcome"])
           for r in IN.route(IN.triage(df.selectExpr("*", "CAST(length(content) AS BIGINT) AS length"))).orderBy("name").collect()]
    assert got == [("text", False, 3, None, None), ("pdf", True, 2, None, "image_only"), ("pdf", True, 1, None, "image_only"),
                   ("error", False, 1, "corrupt-PDF", "parse_failed"), ("error", False, 1, "corrupt-PDF", None), ("image", True, 1, None, None)]
