"""J4 as a stream: replay equals the batch overlay, with late and repeated edits, over a restart."""

import os
import tempfile

from pyspark.sql import functions as F

from ledgerlens.operators import edits as E
from ledgerlens.plans import validation as P
from ledgerlens.sources.invoices import AS_OF, invoice_records
from ledgerlens.streaming.edits import stream_edited_records


def test_replay_equals_batch(spark, sf_small):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rec = invoice_records(spark, sf_small).where("order_key % 5 = 0").select("doc_id", "record").cache()
    base = P.derived_edits(invoice_records(spark, sf_small)).join(rec.select("doc_id"), "doc_id")
    more = [("late", "total", "1,234.50", 5, 1), ("late", "total", "9", 3, 9), ("late", "total", "7", 5, 0), ("late", "due_date", " ", 1, 1),
            ("late", "tax", "x", 9, 9), ("late", "currency", "EUR", 2, 1), ("late", "nothing", "z", 1, 1), ("late", "total", "bad", 99, 1)]
    late = rec.limit(1).select(F.lit("late").alias("doc_id"), "record")
    rec = rec.union(late).cache()
    edits = base.selectExpr("doc_id", "field", "raw", "CAST(ts AS BIGINT) AS ts", "CAST(seq AS BIGINT) AS seq").union(
        spark.createDataFrame(more, "doc_id string, field string, raw string, ts long, seq long")).cache()
    keyed = edits.withColumn("h", F.pmod(F.xxhash64("doc_id", "field", "ts", "seq"), F.lit(3)))
    schema = "doc_id string, field string, raw string, ts long, seq long"

    def run():
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(os.path.join(d, "in"))
        q = (stream_edited_records(src, rec, AS_OF).writeStream.format("parquet").option("path", os.path.join(d, "out"))
             .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
        q.awaitTermination(600)
        assert q.exception() is None
    for k in range(3):
        keyed.where(f"h = {k}").select(*schema.replace(",", "").split()[::2]).coalesce(1).write.parquet(os.path.join(d, "in", f"p{k}"))
        if k == 1:
            run()
    edits.where("doc_id = 'late'").coalesce(1).write.parquet(os.path.join(d, "in", "p3"))   # again
    run()
    out = spark.read.parquet(os.path.join(d, "out"))
    last = out.join(out.groupBy("doc_id").agg(F.max("version").alias("version")), ["doc_id", "version"]).select("doc_id", "edited", "edited_fields", "flags")
    shown = E.with_display_flags(E.apply_edits(rec, edits), AS_OF)
    known = edits.where(F.col("field").isin(*E.EDITABLE)).selectExpr("*", f"{E.coerce_sql()['valid']} AS valid").where("valid").select("doc_id").distinct()
    want = shown.join(known, "doc_id").select("doc_id", "edited", "edited_fields", "flags")
    assert last.count() == want.count() > 10 and last.exceptAll(want).count() == 0
    assert out.groupBy("doc_id", "version").count().where("count > 1").count() == 0
    one = last.where("doc_id = 'late'").first()["edited"]
    assert one["total"]["value"] == 1234.5 and one["due_date"]["value"] is None and one["currency"]["value"] == "EUR"
