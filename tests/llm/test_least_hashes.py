"""Minimum hashes of 32 bits agree as often as sets are alike."""

import numpy as np
import pytest
from tidemark.llm import neardup


@pytest.mark.parametrize("size,share", [(30, 0.8), (700, 0.8), (6000, 0.8), (700, 0.2)])
def test_agreement_is_the_similarity(size, share):
    rng = np.random.default_rng(size)
    found = []
    for _ in range(60):
        both = round(size * share)
        pool = rng.integers(0, 2**64, size=2 * size - both, dtype=np.uint64)
        a, b = pool[:size], pool[size - both :]
        found.append((neardup.least_hashes(a, 186) == neardup.least_hashes(b, 186)).mean())
    assert np.mean(found) == pytest.approx(both / (2 * size - both), abs=0.03)
    assert len(np.unique(neardup.least_hashes(pool, 186))) > 180
