"""Gradient-boosted trees with monotonic constraints, flattened for scoring.

Logistic loss, second-order gains over binned statistics. A constrained
feature admits only splits whose two values keep its direction, and both
sides inherit the middle as a bound, so the whole model is monotonic in it.
Trained trees become five node arrays; a matrix of rows walks all trees level
by level with array indexing.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Node arrays of all trees; a leaf points to itself. ``roots`` are the trees' first nodes."""
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    base: float = 0.0
    depth: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row: a row goes left where its statistic is at most the threshold."""
        total = np.full(len(x), self.base)
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return total + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds per feature, below ``bins``: middles between neighbouring quantiles."""
    out = []
    for col in x.T:
        q = np.unique(np.quantile(col, np.linspace(0, 1, bins), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, direction: dict[int, int], trees: int = 60, depth: int = 3,
        rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """``direction``: feature -> +1 (score never falls as it grows) or -1.

    ``least`` is the smallest sum of second derivatives of a leaf. Without rows of
    both labels the model is the smoothed share of label 1.
    """
    pos = float(weight[y == 1].sum())
    share = (pos + 1) / (float(weight.sum()) + 2)
    out = Trees(base=float(np.log(share / (1 - share))))
    if not 0 < pos < weight.sum():
        return out
    edges = cuts(x, bins)
    code = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)], axis=1)
    n, d = code.shape
    sign = np.array([direction.get(j, 0) for j in range(d)])[:, None]
    flat = code + np.arange(d) * bins
    last = np.array([len(e) for e in edges])[:, None]  # codes of a feature are 0 .. last
    nodes: list[list] = []
    roots = []
    margin = np.full(n, out.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        roots.append(len(nodes))
        grown = []  # (node, rows)

        def leaf(rows, low, high):
            v = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
            nodes.append([0, np.inf, len(nodes), len(nodes), rate * v])
            return len(nodes) - 1

        def grow(rows, low, high, level):
            at = leaf(rows, low, high)
            if level == depth:
                grown.append((at, rows))
                return at
            size = d * bins
            gl = np.bincount(flat[rows].ravel(), np.repeat(g[rows], d), size).reshape(d, bins).cumsum(axis=1)
            hl = np.bincount(flat[rows].ravel(), np.repeat(h[rows], d), size).reshape(d, bins).cumsum(axis=1)
            gs, hs = g[rows].sum(), h[rows].sum()
            gr, hr = gs - gl, hs - hl
            vl, vr = (np.clip(-a / (b + ridge), low, high) for a, b in ((gl, hl), (gr, hr)))
            gain = -(gl * vl + 0.5 * (hl + ridge) * vl ** 2) - (gr * vr + 0.5 * (hr + ridge) * vr ** 2)
            v = float(np.clip(-gs / (hs + ridge), low, high))
            gain += gs * v + 0.5 * (hs + ridge) * v ** 2
            bad = (hl < least) | (hr < least) | (np.arange(bins) >= last) | (sign * (vr - vl) < 0)
            gain = np.where(bad, -np.inf, gain)
            j, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, b] <= 1e-9:
                grown.append((at, rows))
                return at
            goes = code[rows, j] <= b
            mid = (vl[j, b] + vr[j, b]) / 2
            lo, hi = (low, mid), (mid, high)
            if sign[j, 0] < 0:
                lo, hi = (mid, high), (low, mid)
            elif sign[j, 0] == 0:
                lo = hi = (low, high)
            a = grow(rows[goes], *lo, level + 1)
            c = grow(rows[~goes], *hi, level + 1)
            nodes[at][:4] = [int(j), float(edges[j][b]), a, c]
            return at

        grow(np.arange(n), -np.inf, np.inf, 0)
        for at, rows in grown:
            margin[rows] += nodes[at][4]
    return Trees(*(np.array([r[i] for r in nodes], dtype=t) for i, t in enumerate((np.int32, float, np.int32, np.int32, float))),
                 np.array(roots, np.int32), out.base, depth)
