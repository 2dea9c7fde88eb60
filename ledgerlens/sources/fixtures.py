"""Evaluation corpus on storage - one folder per fixture with
``expected.json`` and ``meta.json`` (and the document). A fixture is used
only when all its files exist: the file sets are joined on the folder key
(inner = complete, anti = skipped with the missing part named)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas as S

META_SCHEMA = "id string, category string, source string, notes string"
FOLDER_SQL = "regexp_extract(_metadata.file_path, '/([^/]+)/[^/]+$', 1)"


def _json(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    # explicit schema: whole-number amounts are JSON integers, never inferred
    return (spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", name).json(root)
            .select("*", F.expr(FOLDER_SQL).alias("folder")))


def read_corpus(spark: SparkSession, root: str, document_name: str = "invoice.pdf"):
    """Returns (fixtures, skipped): fixtures = folder, meta columns, the nine
    expected fields, document path, sorted by id; skipped = folder + what is
    missing."""
    expected = _json(spark, root, "expected.json", S.GROUND_TRUTH)
    meta = _json(spark, root, "meta.json", META_SCHEMA)
    docs = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", document_name).load(root)
            .select(F.col("path").alias("document_path"),
                    F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("folder")))
    complete, skipped = complete_or_skipped({"document": docs, "expected.json": expected, "meta.json": meta})
    return complete.orderBy("id"), skipped


def complete_or_skipped(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Tables by ``folder``, one for each part of a fixture: (folders that have every part, joined; the others with the names of the parts
    that are ``missing``, in the given order)."""
    tables = list(parts.values())
    whole, folders = tables[0], tables[0].select("folder")
    for t in tables[1:]:
        whole, folders = whole.join(t, "folder"), folders.union(t.select("folder"))
    skipped = folders.distinct().join(whole.select("folder"), "folder", "left_anti")
    names = []
    for i, (name, t) in enumerate(parts.items()):
        skipped = skipped.join(t.select("folder", F.lit(True).alias(f"_has{i}")), "folder", "left")
        names.append(F.when(F.col(f"_has{i}").isNull(), F.lit(name)))
    return whole, skipped.select("folder", F.concat_ws(", ", *names).alias("missing"))
