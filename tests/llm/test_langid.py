import random
import zlib

import numpy as np
import pytest
from tidemark.llm import langid

STEMS = {"aa": ["the", "ing", "tion", "and"], "bb": ["der", "ung", "keit", "sch"], "cc": ["ción", "los", "ñar", "que"], "dd": ["ment", "eau", "tré", "les"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows = [(k, text(rng, lang := rng.choice(list(STEMS)), rng.randint(5, 60)), lang if k % 9 else None) for k in range(500)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 -- ?!", "cc"), (903, "!!" * 5000, "aa"), (None, text(rng, "bb", 30), "bb"), (904, "x", "aa"), (905, text(rng, "cc", 20_000), "cc")]
    truth = {r[0]: r[2] for r in rows}
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), truth


def test_held_out_accuracy(corpus):
    df, truth = corpus
    got = langid.language(df, per_language=60).collect()
    assert len(got) == len(truth)
    scored = [(r.lang_pred == truth[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500 and truth[r.doc_id]]
    assert len(scored) > 60 and np.mean(scored) > 0.97
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (900, 901, 902, 903))


def test_predictions_ignore_everything_but_the_text(corpus):
    from pyspark.sql import functions as F

    df, _ = corpus
    model = langid.fit_language(df, per_language=60)
    a = model.predict(langid.tk.text_column(df.select("text").toArrow().to_batches()[0], "text"))[0]
    assert set(a) <= {*STEMS, "und"}
    assert langid.known_language(df.withColumn("lang", F.col("lang")), per_language=60).columns == df.columns


def test_no_labels_one_language_and_empty(spark, empty):
    df = spark.createDataFrame([(1, "some words", None), (2, "others", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.language(df).collect()} == {"und"}
    one = spark.createDataFrame([(k, "some words", "en") for k in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.language(one).collect()} == {"en"}
    assert langid.language(empty).count() == 0


def test_repeated_rows_and_clashing_columns(docs, rows):
    labelled = docs.withColumnRenamed("lines", "lang_pred").withColumnRenamed("n_words", "score")
    got = langid.language(labelled).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "de", "und"}
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add(t)
    again = [r for r in got if r.doc_id == 1]
    assert len(again) == 3 and len({tuple(r) for r in again}) == 1 and len([r for r in got if r.doc_id == 2]) == 2
    assert all((r.lang_pred == "und") == (r.score == 0) for r in got)
    kept = langid.known_language(labelled)
    assert kept.columns == labelled.columns and {r["lang_pred"] for r in kept.collect()} <= {"clash"}


def test_an_id_of_many_rows_trains_once(spark):
    rng = random.Random(3)
    rows = [(k, text(rng, "aa" if k % 2 else "bb", 20), "aa" if k % 2 else "bb") for k in range(1, 60)]
    many = [(1, text(rng, "bb", 20), "aa") for _ in range(500)]
    model = langid.fit_language(spark.createDataFrame(rows + many, "doc_id long, text string, lang string"))
    names, _ = model.predict(langid.tk.text_column(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text").toArrow().to_batches()[0], "text"))
    assert np.mean([n == r[2] for n, r in zip(names, rows)]) > 0.95


def test_codewords_are_apart():
    for n in (2, 4, 7, 12, 40):
        m = langid.codewords(n)
        apart = ((m[:, None] != m[None]).sum(axis=2) + 10**6 * np.eye(n)).min()
        assert m.shape[0] == n and apart >= (1 if n == 2 else m.shape[1] // 4)
