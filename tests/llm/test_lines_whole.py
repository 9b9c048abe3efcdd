"""The key of all tokens alone is the one among all keys."""

import numpy as np
import pyarrow as pa
from tidemark.llm import textkit as tk
from tidemark.llm.linededup import Lines


def test_key_of_all_tokens():
    texts = ["", "\n\n", "one", "a b c d e f 12 g\n \nx 3\n\tlast line ", "  \n", "ä ö\nü", " lone "] * 3
    seen = 0
    for g in tk.groups(pa.array(texts, pa.large_string()), 40):
        full, own = Lines(g), Lines(g, whole=True)
        at = full.usable
        seen += int(at.sum())
        assert np.array_equal(own.usable, at) and np.array_equal(own.starts, full.starts) and np.array_equal(own.doc, full.doc)
        assert np.array_equal(own.keys[at, 0], full.keys[at, 0])
    assert seen == 3 * 7
