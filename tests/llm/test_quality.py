import os
import re
from collections import Counter

import numpy as np
import pytest
from tidemark.llm import gbt, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {p for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_base_as_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(3, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert Counter((r[0], *r[1:7]) for r in got) == Counter((r[0], *brute(r[1])) for r in rows)
    assert all(not (r.base_failed and r.kept) for r in got)


def test_without_labels_base_rules_decide(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality.quality(docs, none).collect())
    assert quality.quality(empty, none).count() == 0


def test_learns_and_keeps_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.1 * rng.standard_normal(3000) < 0.6).astype(float)
    free, held = gbt.fit(x, y), gbt.fit(x, y, monotone={0: -1, 2: 1})
    assert ((free.probability(x) > 0.5) == y).mean() > 0.93 and ((held.probability(x) > 0.5) == y).mean() > 0.92
    grid = np.repeat(rng.random((50, 1, 4)), 40, axis=1)
    for f, sign in ((0, -1), (2, 1)):
        g = grid.copy()
        g[:, :, f] = np.linspace(0, 1, 40)
        assert (sign * np.diff(held.margin(g.reshape(-1, 4)).reshape(50, 40), axis=1) >= -1e-12).all()


def test_flat_nodes_score_as_a_walk():
    rng = np.random.default_rng(2)
    x = rng.random((500, 3))
    m = gbt.fit(x, (x[:, 0] > x[:, 1]).astype(float), trees=15)

    def walk(row):
        total = m.base
        for at in m.roots:
            while m.left[at] != at:
                at = m.left[at] if row[m.feature[at]] <= m.threshold[at] else m.right[at]
            total += m.value[at]
        return total

    assert np.allclose(m.margin(x), [walk(r) for r in x])


def test_degenerate_fits():
    assert not len(gbt.fit(np.zeros((0, 3)), np.zeros(0)).roots)
    assert not len(gbt.fit(np.ones((5, 2)), np.ones(5)).roots)
    assert np.isfinite(gbt.fit(np.ones((6, 2)), np.array([0, 1, 0, 1, 1, 1.0])).probability(np.array([[np.nan, 1.0]]))).all()


DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_quality():
    """Trees fitted to every other labelled document, judged on the rest."""
    import duckdb

    found = duckdb.sql(f"select text, quality from '{DATA}/documents.parquet' join '{DATA}/labels.parquet' using (doc_id) where quality is not null order by doc_id").arrow()
    found = found.read_all() if hasattr(found, "read_all") else found
    batch = found.rename_columns(["_text", "label"]).combine_chunks().to_batches()[0]
    x, y = quality.features(quality._batch_statistics(batch)), batch.column("label").to_numpy()
    model = gbt.fit(x[::2], y[::2], trees=40, depth=3, monotone=quality.MONOTONE)
    right = ((model.probability(x[1::2]) >= 0.5) == y[1::2]).mean()
    most = max(y[1::2].mean(), 1 - y[1::2].mean())
    print(f"held-out accuracy {right:.3f}, majority {most:.3f}, {len(y) // 2} documents")
    assert right >= most


def test_labelled_id_of_many_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, "clash"), (2, 0, "clash"), (3, 1, "clash"), (300, 0, "clash")], "doc_id long, quality int, text string")
    assert quality.quality(docs, labels).count() == docs.count()
