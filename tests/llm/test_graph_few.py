"""Components of few edges: one task, the same rows as by rounds."""

import random

from tidemark.llm import graph


def test_few_edges_take_few_jobs_and_give_the_same(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(220)] + [(-(2**62), 2**62), (7, 7), (5000, 5000)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    jobs = {}
    got = {}
    for few in (graph.FEW_EDGES, 0):
        spark.sparkContext.setJobGroup(f"few {few}", "")
        got[few] = sorted(map(tuple, graph.components(df, few).collect()))
        jobs[few] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few {few}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    few, rounds = got.values()
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert few == rounds == sorted(root.items())
    assert jobs[graph.FEW_EDGES] <= 8 < jobs[0]
