"""The pipeline: each stage against what it should leave."""

import corpus_pipeline
from ledgerlens.llm import common, simhash
from ledgerlens.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def test_stages_in_order(spark):
    docs = common.documents(spark, SF)
    cols, size = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == cols
        size.append(docs.count())
        if name == "toxicity":
            toxic = read_table(spark, SF, "labels").where("toxic = 1").select("doc_id")
            assert docs.join(toxic, "doc_id").count() <= 0.1 * toxic.count()
            assert size[-1] >= size[-2] - 1.5 * 1000 * toxic.count() / read_table(spark, SF, "labels").count()
        if name == "simhash_near_dedup":
            groups = simhash.near_duplicates(before)
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
        if name == "source_mixing":
            assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    assert size[0] > size[1] > size[2] > size[3] > 0
    index = corpus_pipeline.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    assert len(index) == size[-1] and [r["doc_id"] for r in index] == sorted(r["doc_id"] for r in index)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(index, index[1:]))


def test_run_and_empty_tables(spark, tmp_path):
    docs = common.documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(rows[0].asDict())
