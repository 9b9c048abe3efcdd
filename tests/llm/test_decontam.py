import hashlib
import re
from collections import Counter, defaultdict

import pytest
from tidemark.llm import decontam

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def brute(rows, items):
    windows = defaultdict(lambda: defaultdict(set))
    for name, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[n][tuple(w[k : k + n])].add(str(name))
    out = []
    for r in rows:
        w, hit, ids = words(r[1]), set(), set()
        for n, own in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in own:
                    ids |= own[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        out.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def items(rows):
    own = [(k, " ".join((rows[k][1] or "").split()[3 : 3 + n])) for k, n in ((0, 30), (4, 13), (7, 5), (9, 1), (14, 14), (305, 40)) if k < len(rows)]
    return own + [(50, None), (51, "--- !!"), (52, own[0][1].upper()), (None, own[1][1] + " extra"), (53, "nowhere to be found at all in these texts, whatever one does about it")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_as_brute_force(spark, docs, rows, items, block_bytes):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench, block_bytes=block_bytes).collect()
    want = brute(rows, [("" if i is None else i, t) for i, t in items])
    assert Counter(map(tuple, got)) == Counter(want) and any(w[-1] for w in want)
    kept = decontam.decontaminate(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter(r[1] for r, w in zip(rows, want) if not w[-1])


def test_empty(spark, docs, empty, rows):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontam.contamination(docs, bench).collect()} == {False}
    assert decontam.contamination(empty, bench).count() == 0 and decontam.decontaminate(docs, bench).count() == len(rows)
