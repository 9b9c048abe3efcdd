from tidemark.llm import mixing


def test_tiny_sources_stay_in_the_mix(spark):
    rows = [(k, "w " * 500, "big") for k in range(20)] + [(100 + k, "w " * (1 + k % 5), f"tiny{k:02d}") for k in range(30)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    tiny = [r for r in got if r.doc_id >= 100]
    assert len(tiny) == 30 and all(r.target > 0 and r.taken > 0 and abs(r.taken - r.target) <= 1 for r in tiny)
    assert abs(sum(r.taken for r in got) - sum(r.size for r in got)) < 32
