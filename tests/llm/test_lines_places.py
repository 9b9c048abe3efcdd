"""Lines go by where they begin: cleaning parses no words, and word hashes are the same however they are reckoned."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tidemark.llm import linededup, neardup
from tidemark.llm import textkit as tk

TEXTS = ["a\nb\n\nc", "a\nb\n", "\n\na", "é x\nü y\nz", "one", "\n"]


def begins(text):
    at = np.cumsum([0] + [len(x.encode()) + 1 for x in text.split("\n")])
    return at[:-1].tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_any_lines_go(text, monkeypatch):
    monkeypatch.setattr(linededup, "Lines", None)
    lines = text.split("\n")
    places = [k for k, x in enumerate(lines) if x]
    rng = random.Random(1)
    for size in range(1, len(places) + 1):
        gone = rng.sample(places, size)
        out, n, dropped = linededup._cleaned(pa.array([text, None, text]), pa.array([[begins(text)[k] for k in gone], None, None], pa.list_(pa.int32())))
        assert out == ["\n".join(x for k, x in enumerate(lines) if k not in gone).encode(), None, text.encode()]
        assert n == [len(lines), 0, len(lines)] and dropped == [size, 0, 0]


def test_a_row_a_line_and_one_vote_a_document():
    texts = ["x y\n\nx y\nx y 1\n \nx y 2", "", "x y"]
    batch = pa.table({"_k": [1, 2, 3], "_j": pa.array([0, 0, 0], pa.int32()), "_text": texts}).to_batches()
    rows = pa.Table.from_batches(linededup._parsed(iter(batch))).to_pylist()
    assert [(r["_k"], r["lo"], r["once"] & 1) for r in rows] == [(1, 0, 1), (1, 5, 0), (1, 9, 1), (1, 17, 0), (3, 0, 1)]
    assert rows[0]["key0"] == rows[1]["key0"] == rows[4]["key0"] and rows[2]["key0"] == rows[3]["key0"]


def test_word_hashes_of_short_and_long_groups(monkeypatch):
    texts = ["", " lone ", "a b  a", "", "é\n" * 50 + "x" * 500, "tail"]
    for g in tk.groups(pa.array(texts, pa.large_string()), 60):
        for which in (0, 1):
            flat = tk.word_hashes(tk.words(g), which)
            with monkeypatch.context() as m:
                m.setattr(tk, "FLAT_BYTES", 0)
                assert np.array_equal(tk.word_hashes(tk.words(g), which), flat)


def test_band_keys_of_many_texts_at_once():
    low = np.random.default_rng(2).integers(0, 2**32, size=(5, 12), dtype=np.uint32)
    assert np.array_equal(neardup.band_keys(low, 4, 3), np.concatenate([neardup.band_keys(low[d : d + 1], 4, 3) for d in range(5)]))


def test_few_powers_are_kept():
    assert tk.FLAT_BYTES <= tk.SMALL_GROUP
    before = {k: len(x) for k, x in tk._powers.items()}
    long = "word " * (tk.SMALL_GROUP // 4)
    for g in tk.groups(pa.array([long], pa.large_string())):
        tk.word_hashes(tk.words(g))
    assert all(len(x) <= max(before.get(k, 0), 4096) for k, x in tk._powers.items())
