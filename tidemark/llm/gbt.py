"""Gradient-boosted trees with monotonic constraints, kept as flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All nodes of all trees: children are positions in the same arrays, a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row, all rows down one tree at a time."""
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(np.nan_to_num(np.asarray(x, dtype=float))), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, shrink: float = 1.0, least: float = 1.0, monotone: dict[int, int] | None = None) -> Trees:
    """Logistic boosting on quantile bins.

    ``monotone`` maps a feature to +1 or -1: such a feature can only raise or
    lower the prediction. A split that would order its two leaves otherwise is
    not taken, and the midpoint of an accepted one bounds everything below it.
    No rows, or rows of one class, give a model without trees.
    """
    x, y = np.nan_to_num(np.asarray(x, dtype=float)), np.asarray(y, dtype=float)
    n, width = x.shape if x.ndim == 2 else (0, 0)
    rate_of_ones = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
        sign = np.array([(monotone or {}).get(f, 0) for f in range(width)])
        column = np.arange(width) * bins
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([0, 0, len(nodes), len(nodes), 0])
            place, level = np.full(n, roots[-1]), {roots[-1]: (-np.inf, np.inf)}
            nodes[-1][4] = rate * float(-g.sum() / (h.sum() + shrink))
            for _ in range(depth):
                ids = np.array(sorted(level))
                slot = np.full(len(nodes), -1)
                slot[ids] = np.arange(len(ids))
                mine = np.flatnonzero(slot[place] >= 0)
                cell = (slot[place[mine]] * (width * bins))[:, None] + column + binned[mine]
                shape = (len(ids), width, bins)
                sums = [np.bincount(cell.ravel(), weights=np.repeat(v[mine], width), minlength=np.prod(shape)).reshape(shape) for v in (g, h)]
                gl, hl = (np.cumsum(s, axis=2)[:, :, :-1] for s in sums)
                gt, ht = (s.sum(axis=2)[:, :1, None] for s in sums)
                gr, hr = gt - gl, ht - hl
                lo, hi = (np.array([level[i][k] for i in ids])[:, None, None] for k in (0, 1))
                vl, vr = np.clip(-gl / (hl + shrink), lo, hi), np.clip(-gr / (hr + shrink), lo, hi)
                score = lambda v, a, b: -(a * v + 0.5 * (b + shrink) * v * v)
                gain = score(vl, gl, hl) + score(vr, gr, hr) - score(np.clip(-gt / (ht + shrink), lo, hi), gt, ht)
                gain[(hl < least) | (hr < least) | (sign[None, :, None] * (vr - vl) < 0)] = -np.inf
                for f in range(width):
                    gain[:, f, len(edges[f]) :] = -np.inf
                best = gain.reshape(len(ids), -1).argmax(axis=1)
                level = {}
                for k, i in enumerate(ids):
                    f, b = divmod(int(best[k]), bins - 1)
                    if not gain[k, f, b] > 1e-9:
                        continue
                    bounds = [(float(lo[k, 0, 0]), float(hi[k, 0, 0]))] * 2
                    if sign[f]:
                        middle = float(vl[k, f, b] + vr[k, f, b]) / 2
                        bounds = [(bounds[0][0], middle), (middle, bounds[0][1])][:: int(sign[f])]
                    nodes[i][:4] = [f, edges[f][b], len(nodes), len(nodes) + 1]
                    for v, bound in zip((vl, vr), bounds):
                        level[len(nodes)] = bound
                        nodes.append([0, 0, len(nodes), len(nodes), rate * float(v[k, f, b])])
                    inside = np.flatnonzero(place == i)
                    place[inside] = np.where(binned[inside, f] <= b, nodes[i][2], nodes[i][3])
                if not level:
                    break
            margin += np.array([v[4] for v in nodes])[place]
    flat = np.array(nodes, dtype=float).reshape(-1, 5)
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, dtype=int), depth, base)
