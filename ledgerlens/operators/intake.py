"""File intake: binary file source (S1), kind triage with magic bytes
(S2), PDF header / empty checks (S3), size caps (S4), input routing (S5),
PDF outcome -> error code (P19). Only the first 12 bytes and the length are
inspected, as column expressions over the ``binaryFile`` schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.sql import js_trim
from ledgerlens.operators.errors import pdf_error_code_sql

MAX_PDF_BYTES = 25 * 1024 * 1024
MAX_IMAGE_BYTES = int(3.5 * 1024 * 1024)

# Declared image types and their canonical media type.
IMAGE_MIME = (("image/jpeg", "image/jpeg"), ("image/jpg", "image/jpeg"), ("image/png", "image/png"),
              ("image/gif", "image/gif"), ("image/webp", "image/webp"))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file (path, modificationTime, length, content, name; no declared type), ready for ``triage``.
    Spark's file sources pass over files of length 0, so those need a listing of their own."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).selectExpr("*", "regexp_extract(path, '([^/]+)$', 1) AS name", "CAST(NULL AS STRING) AS declared_mime")


def triage_sql(name: str = "name", mime: str = "declared_mime", content: str = "content",
               length: str = "length") -> dict[str, str]:
    """S2-S5 as SQL: looks_like_pdf, image_mime, kind, error_code, cap."""
    dm = f"lower(coalesce({mime}, ''))"
    head = f"hex(substring({content}, 1, 12))"
    declared = "map(" + ", ".join(f"'{a}', '{b}'" for a, b in IMAGE_MIME) + ")"
    looks_pdf = f"({dm} = 'application/pdf' OR endswith(lower({name}), '.pdf'))"
    sniff = (f"CASE WHEN {length} >= 3 AND startswith({head}, 'FFD8FF') THEN 'image/jpeg' "
             f"WHEN {length} >= 8 AND startswith({head}, '89504E47') THEN 'image/png' "
             f"WHEN {length} >= 6 AND startswith({head}, '47494638') THEN 'image/gif' "
             f"WHEN {length} >= 12 AND startswith({head}, '52494646') AND substr({head}, 17, 8) = '57454250' "
             f"THEN 'image/webp' END")
    image = f"CASE WHEN {looks_pdf} THEN NULL ELSE coalesce(try_element_at({declared}, {dm}), {sniff}) END"
    cap = f"CASE WHEN ({image}) IS NOT NULL THEN {MAX_IMAGE_BYTES} ELSE {MAX_PDF_BYTES} END"
    outcome = (f"CASE WHEN {length} = 0 THEN 'empty_file' "
               f"WHEN NOT startswith({head}, '255044462D') THEN 'not_a_pdf' END")
    err = (f"CASE WHEN NOT {looks_pdf} AND ({image}) IS NULL THEN 'non-PDF' "
           f"WHEN {length} > {cap} THEN 'oversized-PDF' "
           f"WHEN ({image}) IS NULL THEN {pdf_error_code_sql(outcome)} END")
    kind = (f"CASE WHEN ({err}) IS NOT NULL THEN 'error' WHEN ({image}) IS NOT NULL THEN 'image' "
            f"ELSE 'pdf' END")
    return {"looks_like_pdf": looks_pdf, "image_mime": image, "cap_bytes": cap,
            "error_code": err, "kind": kind}


def triage(files: DataFrame) -> DataFrame:
    """Adds kind / image_mime / error_code / cap_bytes / vision_used. PDFs
    that pass the header check go to text extraction (byte parsing is not
    built); images are routed to vision."""
    t = triage_sql()
    return files.selectExpr("*", *[f"{v} AS {k}" for k, v in t.items()]).selectExpr(
        "*", "kind = 'image' AS vision_used")


def route(files: DataFrame) -> DataFrame:
    """S3, S5, P19 after a text extractor has run over the PDFs of ``triage``: columns ``pdf_text`` (the text layer), ``pdf_pages`` and
    ``pdf_failed`` (the extractor gave up) come in, ``outcome``, ``input`` (image, pdf, text or error), ``vision_used``, ``num_pages``
    (1 unless known) and ``category`` (of the log line) go out. A PDF without text is no error: its bytes go to vision."""
    out = files.selectExpr(
        "*", "CASE WHEN kind <> 'pdf' THEN NULL WHEN coalesce(pdf_failed, false) THEN 'parse_failed' "
             f"WHEN coalesce({js_trim('pdf_text')}, '') = '' THEN 'image_only' END AS outcome").drop("vision_used")
    out = out.withColumn("error_code", F.expr(f"CASE WHEN outcome = 'parse_failed' THEN {pdf_error_code_sql('outcome')} ELSE error_code END"))
    return out.selectExpr(
        "*", "CASE WHEN error_code IS NOT NULL THEN 'error' WHEN kind = 'image' THEN 'image' WHEN outcome = 'image_only' THEN 'pdf' ELSE 'text' END AS input",
        ).selectExpr("*", "input IN ('image', 'pdf') AS vision_used",
                     "CASE WHEN kind = 'pdf' AND input <> 'error' THEN coalesce(pdf_pages, 1) ELSE 1 END AS num_pages",
                     "CASE input WHEN 'image' THEN 'image-received' WHEN 'pdf' THEN 'pdf-vision-fallback' WHEN 'text' THEN 'pdf-parsed' "
                     "ELSE error_code END AS category")
