"""What the pipeline's line dedup has to take out."""

import corpus_pipeline


def cleaned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}


def own(k, n=40):
    return " ".join(f"w{chr(97 + k % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}{chr(97 + k // 26)}" for j in range(n))


def test_lines_of_one_and_two_words(spark):
    got = cleaned(spark, [f"Share this\n{own(k)}\n \nMore" + ("\nonly here" if k == 3 else "") for k in range(12)])
    assert got == {k: f"{own(k)}\n " + ("\nonly here" if k == 3 else "") for k in range(12)}


def test_short_documents_with_one_notice(spark):
    notice = own(30, 12)
    copy = [f"{own(50)} {own(51)} copied\n{own(52)} {own(53)}\n{own(54)} tail{k}" for k in range(12)]
    got = cleaned(spark, [f"{own(k, 28)}\n{notice}" for k in range(12)] + copy)
    assert got == {k: own(k, 28) for k in range(12)} | {12 + k: copy[k] for k in range(12)}


def test_long_lines_of_two_documents(spark):
    passage, notice, table = own(30, 60), own(31, 12), " ".join(map(str, range(20)))
    texts = [own(k) + (f"\n{passage}" if k < 2 else "") + (f"\n{notice}" if 1 < k < 5 else "") + ("\nA short line" if k < 9 else "") + (f"\n{table}" if k > 9 else "") for k in range(12)]
    got = cleaned(spark, texts)
    assert got == {k: own(k) + ("\nA short line" if k < 9 else "") + (f"\n{table}" if k > 9 else "") for k in range(12)}
