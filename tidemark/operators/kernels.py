"""Statistics of long windows, a group at a time in numpy.

Spark reckons every sliding frame anew for each row, in interpreted steps; here a
frame is a line of a matrix. Missing values are NaN. Sums are taken about a value
of the frame itself, so a frame of equal values has a variance of exactly zero and
few digits are lost; what isn't known is NaN.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of a matrix of frames at a time.
CELLS = 1 << 16


def by_group(rows: DataFrame, by: str, order: str, inputs: list[str], outputs: list[str], f: Callable[..., tuple]) -> DataFrame:
    """``rows`` with the columns ``outputs``: ``f`` gets a group's ``inputs`` in order, as arrays of doubles, and gives as many arrays as outputs.

    Inputs whose names begin with an underscore don't come back. The row number makes
    Spark keep groups whole and sorted, and shows where they begin.
    """
    rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    kept = [c for c in rows.columns if not c.startswith("_") or c not in ["_row", *inputs]]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), *(f"`{c}` double" for c in outputs)])

    def whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.concat_batches(batches) if len(batches) > 1 else batches[0]
        starts = np.flatnonzero(batch.column("_row").to_numpy() == 1)
        given = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in inputs]
        made = np.full((len(outputs), batch.num_rows), np.nan)
        with np.errstate(all="ignore"):
            for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows)):
                for out, value in zip(made, f(*(x[lo:hi] for x in given))):
                    out[lo:hi] = value
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, from_pandas=True) for x in made)], [*kept, *outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_row").to_numpy() == 1)
            if len(starts):
                done = [*begun, batch.slice(0, starts[-1])] if starts[-1] else begun
                if done:
                    yield whole(done)
                begun = [batch.slice(starts[-1])]
            elif batch.num_rows:
                begun.append(batch)
        if begun:
            yield whole(begun)

    return rows.mapInArrow(run, schema)


class Frames:
    """The last ``n`` rows at each row: values less the last one that is there (0 for missing ones), and their counts."""

    def __init__(self, x: np.ndarray, n: int):
        self.there = ~np.isnan(x)
        self.n = min(n, len(x))
        place = np.maximum.accumulate(np.where(self.there, np.arange(len(x)), -1))
        filled = np.where(self.there, x, 0.0)
        self.about = filled[place]
        seen = np.cumsum(self.there)
        self.count = (seen - np.append(np.zeros(self.n, dtype=seen.dtype), seen)[: len(x)]).astype(np.float64)
        before = np.zeros(self.n - 1)
        self._values = sliding_window_view(np.append(before, filled), self.n)
        self._weights = sliding_window_view(np.append(before, self.there.astype(np.float64)), self.n)

    def pieces(self) -> Iterator[slice]:
        step = max(1, CELLS // self.n)
        for lo in range(0, len(self.about), step):
            yield slice(lo, lo + step)

    def weights(self, at: slice) -> np.ndarray:
        return self._weights[at]

    def shifted(self, at: slice) -> np.ndarray:
        e = self._values[at] - self.about[at, None]
        e *= self._weights[at]
        return e


def z(x: np.ndarray, n: int = 252, least: int = 60) -> np.ndarray:
    """The distance from the frame's mean in its deviations."""
    out = np.full(len(x), np.nan)
    if np.count_nonzero(~np.isnan(x)) < max(least, 2):
        return out
    f = Frames(x, n)
    for at in f.pieces():
        e, k = f.shifted(at), f.count[at]
        s = e.sum(axis=1)
        var = (np.einsum("ij,ij->i", e, e) - s * s / k) / (k - 1)
        out[at] = np.where(f.there[at] & (k >= least) & (var > 0), -(s / k) / np.sqrt(var), np.nan)
    return out


def shape(x: np.ndarray, n: int = 504, least: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Sample skewness (G1) and excess kurtosis (G2); a variance that is nothing beside the group's gives none."""
    skew, kurt = np.full(len(x), np.nan), np.full(len(x), np.nan)
    if np.count_nonzero(~np.isnan(x)) < max(least, 4):
        return skew, kurt
    f = Frames(x, n)
    floor = 1e-10 * np.nanvar(x)
    for at in f.pieces():
        d, k = f.shifted(at), f.count[at]
        d -= (d.sum(axis=1) / k)[:, None]
        d *= f.weights(at)
        d2 = d * d
        m2, m3, m4 = d2.sum(axis=1) / k, np.einsum("ij,ij->i", d2, d) / k, np.einsum("ij,ij->i", d2, d2) / k
        ok = (k >= max(least, 4)) & (m2 > floor)
        skew[at] = np.where(ok, np.sqrt(k * (k - 1)) / (k - 2) * m3 / m2**1.5, np.nan)
        kurt[at] = np.where(ok, (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * (m4 / (m2 * m2) - 3) + 6), np.nan)
    return skew, kurt


def corr(a: np.ndarray, b: np.ndarray, n: int = 504, least: int = 120) -> np.ndarray:
    """Correlation over rows that have both; none where one doesn't vary."""
    out = np.full(len(a), np.nan)
    both = ~np.isnan(a) & ~np.isnan(b)
    if np.count_nonzero(both) < max(least, 2):
        return out
    f, g = Frames(np.where(both, a, np.nan), n), Frames(np.where(both, b, np.nan), n)
    for at in f.pieces():
        x, y, k = f.shifted(at), g.shifted(at), f.count[at]
        sx, sy = x.sum(axis=1), y.sum(axis=1)
        vx, vy = np.einsum("ij,ij->i", x, x) - sx * sx / k, np.einsum("ij,ij->i", y, y) - sy * sy / k
        both_vary = (k >= least) & (vx > 0) & (vy > 0)
        out[at] = np.where(both_vary, (np.einsum("ij,ij->i", x, y) - sx * sy / k) / (np.sqrt(vx) * np.sqrt(vy)), np.nan)
    return out


def lag(x: np.ndarray) -> np.ndarray:
    return np.append(np.nan, x[:-1])


def ffill(x: np.ndarray) -> np.ndarray:
    """Missing values as the last one before."""
    place = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))
    return np.where(place >= 0, x[place], np.nan)


def persistence(x: np.ndarray, so_far: bool, least: int = 8) -> np.ndarray:
    """Correlation of the values that are there with the one before each, over the group, or over its rows so far."""
    out, at = np.full(len(x), np.nan), np.flatnonzero(~np.isnan(x))
    if len(at) < max(least, 3):
        return out
    a, b = x[at[:-1]], x[at[1:]]
    if so_far:
        a, b, k = a - a[0], b - b[0], np.arange(1.0, len(at))
        sa, sb = np.cumsum(a), np.cumsum(b)
        va, vb, c = np.cumsum(a * a) - sa * sa / k, np.cumsum(b * b) - sb * sb / k, np.cumsum(a * b) - sa * sb / k
    else:
        a, b = a - a[0], b - b[0]
        a, b = a - a.mean(), b - b.mean()
        va, vb, c = np.array([a @ a]), np.array([b @ b]), np.array([a @ b])
    value = np.where((va > 0) & (vb > 0), c / (np.sqrt(va) * np.sqrt(vb)), np.nan)
    if not so_far:
        out[:] = value[0]
        return out
    found = np.full(len(x), np.nan)
    seen = np.cumsum(~np.isnan(x))
    ok = seen >= max(least, 2)
    found[ok] = value[seen[ok] - 2]
    return found


def rank_pct_so_far(x: np.ndarray) -> np.ndarray:
    """The same as ``rank_pct`` among the values so far only."""
    out, seen = np.full(len(x), np.nan), []
    for i in np.flatnonzero(~np.isnan(x)).tolist():
        v = float(x[i])
        lo, hi = bisect_left(seen, v), bisect_right(seen, v)
        seen.insert(hi, v)
        out[i] = (lo + (hi - lo + 2) / 2) / len(seen)
    return out


def row_mean(*xs: np.ndarray) -> np.ndarray:
    """Mean of the values that are there."""
    n = sum((~np.isnan(x)).astype(np.float64) for x in xs)
    return np.where(n > 0, sum(np.nan_to_num(x) for x in xs) / n, np.nan)


def rank_pct(x: np.ndarray) -> np.ndarray:
    """Share of the group's values at or below, ties at their mean rank."""
    out, there = np.full(len(x), np.nan), ~np.isnan(x)
    if there.any():
        _, place, same = np.unique(x[there], return_inverse=True, return_counts=True)
        out[there] = (np.cumsum(same) - same + 1 + (same - 1) / 2)[place] / there.sum()
    return out


def innovations(x: np.ndarray) -> np.ndarray:
    """Standardised innovations of a one-dimensional level filter on the logarithm of a value; the first sets the level."""
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(x > 0)
    if len(at) < 2:
        return out
    logs = np.log(x[at]).tolist()
    level, spread, found = logs[0], 1.0, []
    for v in logs[1:]:
        spread += 1e-4
        total = spread + 1e-2
        step = v - level
        found.append(step / total**0.5)
        level += spread / total * step
        spread *= 1 - spread / total
    out[at[1:]] = found
    return out
