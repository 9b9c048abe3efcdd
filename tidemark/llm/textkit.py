"""Vectorised text primitives over Arrow string buffers, shared by the corpus operators.

Everything works on the UTF-8 bytes of a whole Arrow batch, cut into groups of
documents of about ``GROUP_BYTES`` so that the numpy scratch arrays stay small
whatever the batch holds; a longer document forms a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
#: For work with a dozen arrays of a value a byte or token, so that these stay in the cache.
SMALL_GROUP = 1 << 18
#: Up to so many bytes, a power for each of them is kept (16 bytes a byte): the size of a small group.
FLAT_BYTES = SMALL_GROUP

_rng = np.random.default_rng(20240229)
#: One random 64-bit value a byte; two tables give two independent hashes.
BYTE_VALUES = _rng.integers(1, 2**64, size=(2, 256), dtype=np.uint64)
#: Odd multipliers, so that every power has an inverse modulo 2**64.
BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
GRAM_FACTORS = _rng.integers(1, 2**64, size=(2, 64), dtype=np.uint64) | np.uint64(1)

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """The first ``n`` (or more) powers of a base, or of its inverse, modulo 2**64."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = int(BASES[which])
        if inverse:
            base = pow(base, -1, 2**64)
        steps = np.full(max(n, 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[which, inverse] = np.cumprod(steps, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def byte_class(spec: str) -> np.ndarray:
    """A 256-entry mask from a list of hex ranges such as ``"30-39 61-7A"``."""
    mask = np.zeros(256, dtype=bool)
    for part in spec.split():
        lo, _, hi = part.partition("-")
        mask[int(lo, 16) : int(hi or lo, 16) + 1] = True
    return mask


#: Words of the contracts: everything but blank and the ASCII white space controls.
WORD = ~byte_class("20 09-0D")
#: Lower-cased ASCII letters, digits and all non-ASCII bytes.
ALNUM = byte_class("30-39 61-7A 80-FF")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column as large_string, nulls as empty."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


@dataclass
class Group:
    """Some consecutive documents of a batch: their bytes, and where each begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first


def groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[Group]:
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield Group(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


@dataclass
class Words:
    """Word spans of a group, in order: byte ranges, document, and where each document's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    inside: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words(group: Group, allowed: np.ndarray = WORD, lower: bool = False) -> Words:
    data = LOWER[group.data] if lower else group.data
    inside = allowed[data]
    n = len(data)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    edges = group.offsets[:-1]
    before[edges[edges < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    tails = group.offsets[1:]
    after[tails[tails > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, group.offsets)
    doc = np.repeat(np.arange(len(group)), np.diff(bounds))
    return Words(starts, ends, doc, bounds, data, inside)


def span_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each span; spans don't overlap, and ``inside`` is false between them."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    if len(data) <= FLAT_BYTES:
        # Powers counted from the first byte instead of each span's, which is put right span by span.
        value = BYTE_VALUES[which][data]
        value *= powers(len(data), which)[: len(data)]
        value *= inside
        total = np.add.reduceat(value, starts)
        total *= powers(len(data), which, inverse=True)[starts]
        return mix(total + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = int(starts[0])
    at = np.arange(first, len(data), dtype=np.int64)
    at -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    at *= inside[first:]
    value = BYTE_VALUES[which][data[first:]]
    value *= powers(int((ends - starts).max()) + 1, which)[at]
    value *= inside[first:]
    total = np.add.reduceat(value, starts - first)
    return mix(total + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(w: Words, which: int = 0) -> np.ndarray:
    return span_hashes(w.data, w.inside, w.starts, w.ends, which)


def grams(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` consecutive hashes, across documents too: see ``gram_mask``."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = hashes[:size] * GRAM_FACTORS[which][0]
    for j in range(1, n):
        total += hashes[j : j + size] * GRAM_FACTORS[which][j]
    return mix(total + np.uint64(n))


def gram_mask(doc: np.ndarray, n: int) -> np.ndarray:
    """Which runs of ``n`` stay inside one document."""
    size = len(doc) - n + 1
    return doc[:size] == doc[n - 1 :] if size > 0 else np.zeros(0, dtype=bool)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    size = len(x) - width + 1
    if size <= 0:
        return x[:0]
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return np.minimum(out[:size], out[width - span : width - span + size])


class Lookup:
    """Membership in a set of 64-bit hashes: a bit table first, then a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << 16 if len(self.keys) < 4096 else 1 << 21, dtype=bool)
        self.bits[self._slot(self.keys)] = True

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x & np.uint64(len(self.bits) - 1)).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``x`` that are in the set, and their places among ``keys``."""
        if not len(self.keys) or not len(x):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        maybe = np.flatnonzero(self.bits[self._slot(x)])
        place = np.searchsorted(self.keys, x[maybe])
        place[place == len(self.keys)] = 0
        sure = self.keys[place] == x[maybe]
        return maybe[sure], place[sure]


def list_column(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    """An Arrow list column from the length of each list and all values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), type=pa.int32()), values)
