"""S7 / J8 as files arrive: replay equals the batch reader."""

import json
import os
import tempfile
import time

from ledgerlens import schemas as S
from ledgerlens.sources.fixtures import read_corpus
from ledgerlens.streaming.fixtures import stream_corpus, stream_parts


def put(root, folder, *names):
    os.makedirs(os.path.join(root, folder), exist_ok=True)
    for name in names:
        with open(os.path.join(root, folder, name), "w") as f:
            if name == "invoice.pdf":
                f.write("%PDF-1.4 " + folder)
            elif name == "meta.json":
                json.dump({"id": folder, "category": "c", "source": "s", "notes": None}, f, indent=1)
            else:
                json.dump({n: (12.5 if n in S.NUMBER_FIELDS else f"{n} of {folder}") for n in S.GROUND_TRUTH.names}, f, indent=1)


def test_replay_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    root = os.path.join(d, "corpus")

    def run(wait):
        q = (stream_corpus(stream_parts(spark, root), wait).writeStream.format("parquet").option("path", os.path.join(d, "out"))
             .option("checkpointLocation", os.path.join(d, "state")).trigger(availableNow=True).start())
        q.awaitTermination(300)
        assert q.exception() is None
    put(root, "a", "expected.json", "invoice.pdf")
    put(root, "b", "expected.json", "meta.json", "invoice.pdf")
    put(root, "c", "meta.json")
    run(600_000)
    put(root, "a", "meta.json")
    put(root, "d", "expected.json")
    run(1)                              # what still waits after this run is late in the next one
    time.sleep(0.2)
    put(root, "c", "invoice.pdf")
    put(root, "z", "expected.json", "meta.json", "invoice.pdf")
    run(1)
    out = spark.read.parquet(os.path.join(d, "out"))
    whole, skipped = read_corpus(spark, root)
    cols = [c for c in whole.columns if c != "document_path"]
    got = out.where("missing IS NULL")
    assert {r["folder"] for r in got.collect()} == {"a", "b", "z"}
    assert got.select(*cols).exceptAll(whole.select(*cols)).count() == 0 and whole.count() == 3
    assert {r["document_path"] for r in got.collect()} == {r["document_path"] for r in whole.collect()}
    late = {r["folder"]: r["missing"] for r in out.where("missing IS NOT NULL").collect()}
    assert late.get("d") == "document, meta.json" and set(late) <= {"c", "d"}
    assert out.groupBy("folder").count().where("count > 1").count() == 0
    assert {r["folder"] for r in skipped.collect()} == {"c", "d"}
