"""Texts go to Python, and come from Parquet, in batches of bounded size, whatever their length."""

import pytest
from tidemark.llm import common, decontam, langid, linededup, neardup

SMALL = 4 << 20


def operators(docs, benchmark):
    yield lambda: langid.known_language(docs)
    yield lambda: linededup.without_boilerplate(docs)
    yield lambda: neardup.one_of_each(docs)
    yield lambda: decontam.decontaminate(docs, benchmark)


@pytest.mark.parametrize("k", range(4))
def test_batches_are_small(spark, k):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    for key in common._BATCHES:
        spark.conf.unset(key)
    docs = spark.createDataFrame([(1, "a few words of text", "en", "s0", 19)], "doc_id long, text string, lang string, source string, n_chars long")
    benchmark = spark.createDataFrame([("x", "words of an item")], "item_id string, text string")
    list(operators(docs, benchmark))[k]()
    # 3,000 texts of 10 KB and one that is longer than a batch: all rows pass, a text at most over the size.
    wide = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id % 10 as string), if(id = 1500, 6000000, 10000)) as text")
    got = wide.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 3000 and sum(r.size for r in got) >= 2999 * 10_000 + 6_000_000
    assert max(r.size for r in got) < SMALL + 6_100_000 and sorted(r.size for r in got)[-2] < SMALL + 100_000
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_own_settings_stay(spark):
    for key in common._BATCHES:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "100")
    common.small_batches(spark)
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "100"
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
