import hashlib
import re
from collections import Counter

import pytest
from tidemark.llm import suffixdedup


def brute(texts, depth):
    seen = Counter(t[s : s + depth] for t in texts for s in range(len(t) - depth + 1))
    out = []
    for t in texts:
        cover, end = bytearray(len(t)), 0
        for s in range(len(t) - depth + 1):
            if seen[t[s : s + depth]] > 1:
                lo = max(s, end)
                cover[lo : s + depth] = b"\1" * (s + depth - lo)
                end = s + depth
        kept = bytes(c for c, k in zip(t, cover) if not k)
        out.append((len(t), sum(cover), len(re.findall(b"\1+", cover)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("depth,gram,piece", [(200, 40, 16), (60, 12, 4), (25, 24, 16)])
def test_as_brute_force(docs, rows, depth, gram, piece):
    got = suffixdedup.suffix_dedup(docs, digest=True, depth=depth, gram=gram, piece=piece).collect()
    want = [(r[0], *w) for r, w in zip(rows, brute([(r[1] or "").encode() for r in rows], depth))]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_texts_and_spans(spark):
    a, b = "q" * 10 + "".join(chr(33 + i % 90) for i in range(300)), "".join(chr(33 + i % 90) for i in range(300)) + "zz"
    rows = {r.doc_id: r for r in suffixdedup.suffix_dedup(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    assert bytes(rows[1].kept) == b"q" * 10 and rows[1].spans == [10, 310]
    assert bytes(rows[2].kept) == b"zz" and rows[2].spans == [0, 300]


def test_empty(empty):
    assert suffixdedup.suffix_dedup(empty, digest=True).count() == 0
