import math
import re
from collections import Counter, defaultdict

import pytest
from test_neardup import brute as similar
from tidemark.llm import linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def templates(line):
    """Keys of a line's templates with their fixed words."""
    t = ["<*>" if re.search("[0-9]", x) else x for x in WORD.findall(line)]
    n = len(t)
    if not n:
        return {}
    out = {("all", n, tuple(t)): sum(x != "<*>" for x in t)}
    for j in range(4):
        at = [p for p in range(3, n) if (p - 3) * 4 // max(n - 3, 1) == j]
        if at and n - len(at) > 3:
            out[j, n, tuple("?" if p in at else x for p, x in enumerate(t))] = sum(x != "<*>" for p, x in enumerate(t) if p not in at)
    return out


def brute(rows, least):
    lines = [[(x, templates(x)) for x in (r[1] or "").split("\n")] if r[1] is not None else [] for r in rows]
    fixed = {k: f for own in lines for _, ks in own for k, f in ks.items()}
    enough = lambda k, n: n >= min(least, max(2, math.ceil(30 / fixed[k]) if fixed[k] else least))
    count = Counter()
    for own in lines:
        count.update({k for _, ks in own for k in ks})
    hot = {k for k, n in count.items() if enough(k, n)}
    some = [i for i, own in enumerate(lines) if any(k in hot for _, ks in own for k in ks)]
    group = similar([rows[i] for i in some])[1]
    classes = defaultdict(set)
    for place, i in enumerate(some):
        for _, ks in lines[i]:
            for k in ks:
                classes[k].add(group[place])
    out = []
    for r, own in zip(rows, lines):
        kept = [x for x, ks in own if not any(k in hot and enough(k, len(classes[k])) for k in ks)]
        out.append((r[0], len(own) if r[1] else 0, len(own) - len(kept), None if r[1] is None else "\n".join(kept)))
    return out


@pytest.mark.parametrize("least", [5, linededup.MIN_DOCS])
def test_as_brute_force(docs, rows, least):
    got = linededup.line_dedup(docs, min_docs=least).collect()
    want = brute(rows, least)
    assert Counter(map(tuple, got)) == Counter(want) and sum(w[2] for w in want) >= 10


def dropped(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_dropped, r.text) for r in linededup.line_dedup(docs).collect()}


def own(k, n):
    return " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(n))


def test_every_line_of_a_template_goes(spark):
    got = dropped(spark, [f"{own(k, 20)}\nPosted in forum section today by user {own(k, 1)}\n{own(k + 30, 20)}\nPosted in forum section today by user {own(k + 60, 1)}" for k in range(30)])
    assert got == {k: (2, f"{own(k, 20)}\n{own(k + 30, 20)}") for k in range(30)}


def test_short_lines_and_short_documents(spark):
    notice = own(400, 10)
    texts = [f"{own(k, 20)}\nRead more\nMore" for k in range(30)] + [f"{own(100 + k, 2)}\n{notice}" for k in range(300)]
    got = dropped(spark, texts)
    assert got == {k: (2, own(k, 20)) for k in range(30)} | {30 + k: (1, own(100 + k, 2)) for k in range(300)}


def test_copies_are_one_text(spark):
    copy = "\n".join(own(k, 20) for k in range(5))
    near = [copy.replace(own(0, 20), own(0, 19) + f" end{k}") for k in range(20)]
    assert dropped(spark, [copy] * 30 + near) == {k: (0, t) for k, t in enumerate([copy] * 30 + near)}


def test_rows_and_columns_stay(docs, rows):
    out = linededup.without_boilerplate(docs, min_docs=5)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = out.collect()
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["lines"] == "clash" for r in got)
    assert Counter(r["text"] for r in got) == Counter(w[3] for w in brute(rows, 5))


def test_empty(empty):
    assert linededup.line_dedup(empty).count() == 0 and linededup.without_boilerplate(empty).count() == 0
