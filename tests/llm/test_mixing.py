import re
from collections import defaultdict

import pytest
from tidemark.llm import mixing


def targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[k % 3] for k, n in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        over = [n for n in free if left * w[n] > 3 * sizes[n] * sum(w[m] for m in free) + 1e-9]
        if not over:
            total = sum(w[n] for n in free)
            return out | {n: left * w[n] / total for n in free}
        out |= {n: 3 * sizes[n] for n in over}
        free -= set(over)
        left = sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("block,spread", [(32, 2000), (7, 50)])
def test_targets_quotas_and_limits(docs, rows, block, spread):
    got = mixing.mix(docs, block=block, spread=spread).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = targets(by)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert {k[0] for k in taken} == set(by.values())
    for name, size in by.items():
        assert abs(taken[size, round(want[name], 6)] - want[name]) <= max(0.02 * want[name], 12 * block), name
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2), block=block, spread=spread).collect()))


def test_highest_quotients(spark):
    votes = [(0, 1, 53.0), (0, 2, 24.0), (0, 3, 23.0), (0, 4, 0.0), (1, 1, 7.0), (1, 2, 7.0), (1, 3, 1.0)]
    df = spark.createDataFrame(votes, "g int, place int, votes double")
    from pyspark.sql import functions as F

    for seats in (0, 1, 7, 10, 101):
        got = {(r.g, r.place): r.quota for r in mixing.sainte_lague(df, ["g"], F.lit(seats)).collect()}
        for g in (0, 1):
            own = {p: v for h, p, v in votes if h == g}
            want = dict.fromkeys(own, 0)
            for _ in range(seats):
                best = max(own, key=lambda p: (own[p] / (2 * want[p] + 1), -p))
                want[best] += 1
            assert {p: got[g, p] for p in own} == want


def test_all_full_and_empty(spark, empty):
    one = spark.createDataFrame([(1, "a b c d", "s"), (2, None, "t")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(one, block=1).collect()}
    assert got[1].taken == 4 and got[1].target == 4.0 and got[2].taken == 0 and got[2].target == 0.0
    assert mixing.mix(empty).count() == 0
