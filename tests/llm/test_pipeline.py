from collections import Counter

import corpus_pipeline
from assayframe.llm.secrets import scan
from tests.llm.test_decontaminate import brute as contaminated


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "mix":
            assert docs.columns == columns and docs.count() == len(after) and all(after[i].text == before[i].text for i in after)
        gone = set(before) - set(after)
        if name == "language":
            assert len(gone) <= 0.02 * len(before)
        if name == "near_duplicates":
            texts = Counter(r.text for r in after.values())
            assert max(texts.values()) == 1 and {r.text for r in before.values()} >= set(texts)
        if name == "decontaminate":
            assert gone == {d for d, *_ in contaminated([(r.doc_id, r.text) for r in before.values()], items)}
        if name == "secrets":
            assert gone == {i for i, r in before.items() if scan(r.text)[1]}
        before = after
    assert {"mix_epoch", "mix_order"} <= set(docs.columns)


def test_run_equals_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    rows = lambda df: Counter((r.doc_id, r.mix_epoch, r.mix_tokens, r.mix_order) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, sf)) == rows(docs) and docs.count() > 0
    # its own output can go through all stages again
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() > 0


def test_odd_rows(spark, sf, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() <= 40
        assert stage(spark, odd_docs.limit(0), sf).count() == 0
