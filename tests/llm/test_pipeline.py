import os

import corpus_pipeline
import pytest

DATA = "/root/testdata/sf0.001"


def test_stages_call_their_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "source_mixing"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_run_is_the_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= before
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_take_empty_tables(spark, docs, empty):
    own = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, own, DATA).count() == 0
