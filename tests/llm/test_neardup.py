import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tidemark.llm import graph, neardup


def sets(rows):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        n = min(5, len(w))
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set())
    return out


def brute(rows):
    s = sets(rows)
    links = defaultdict(set)
    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 5 * both >= 4 * (len(s[i]) + len(s[j]) - both):
                links[i].add(j)
                links[j].add(i)
    group = {}
    for i in range(len(s)):
        if i not in group:
            todo = [i]
            group[i] = i
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group[j] = i
                        todo.append(j)
    low = {}
    for i, g in group.items():
        if rows[i][0] is not None:
            low[g] = min(low.get(g, 10**9), rows[i][0])
    return [(r[0], low.get(group[i]) if s[i] else r[0], len(links[i])) for i, r in enumerate(rows)], group


@pytest.mark.parametrize("block", [2048, 3])
def test_as_brute_force(docs, rows, block):
    got = neardup.jaccard_join(docs, block_rows=block)
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows)[0])


def test_one_of_each(docs, rows):
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and {r["_id"] for r in kept.collect()} == {"clash"}
    want, group = brute(rows)
    with_words = [i for i, s in enumerate(sets(rows)) if s]
    ids = sorted(str(r.doc_id) for r in kept.collect())
    expected = [str(min((rows[j][0] for j in with_words if group[j] == g and rows[j][0] is not None), default=None)) for g in {group[i] for i in with_words}]
    assert ids == sorted(expected + [str(r[0]) for r, s in zip(rows, sets(rows)) if not s])


def test_bands_reach_recall():
    bands, rows = neardup.plan_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and 1 - (1 - 0.2**rows) ** bands < 0.01


def test_dense_and_sparse_counts_agree():
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 80, dtype=np.uint64)
    s = [np.unique(np.concatenate([rng.permutation(base)[: 80 - k % 20], rng.integers(0, 2**63, k % 7, dtype=np.uint64)])) for k in range(120)]
    got = {(min(a, b), max(a, b)) for i, j in neardup._links(s, np.arange(120), None, (4, 5)) for a, b in zip(i.tolist(), j.tolist())}
    want = {(i, j) for j in range(120) for i in range(j) for both in [len(np.intersect1d(s[i], s[j]))] if 5 * both >= 4 * (len(s[i]) + len(s[j]) - both)}
    assert got == want
    cross = {(min(a, b), max(a, b)) for i, j in neardup._links(s, np.arange(50), np.arange(50, 120), (4, 5)) for a, b in zip(i.tolist(), j.tolist())}
    assert cross == {(i, j) for i, j in want if i < 50 <= j}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 100)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and {got[k] for k in (100, 101, 102, 200)} == {100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(empty):
    assert neardup.jaccard_join(empty).count() == 0 and neardup.one_of_each(empty).agg(F.count("*")).first()[0] == 0
