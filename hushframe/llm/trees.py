"""Small tree learners in numpy: a decision tree, and gradient-boosted trees with monotonic constraints.

Both fit on a bounded table on the driver and are flattened into parallel node arrays (feature, threshold,
left, right, value), scored for a whole batch at once: all rows step down one level together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Nodes:
    """One or more trees in flat arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Base plus the sum of the trees' values for each row of ``x``; a value equal to the threshold goes left."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Candidate thresholds of each feature: midpoints of at most ``bins`` quantiles."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1), method="lower"))
        out.append((v[:-1] + v[1:]) / 2)
    return out


class _Grower:
    def __init__(self) -> None:
        self.f, self.t, self.l, self.r, self.v = [], [], [], [], []

    def leaf(self, value: float) -> int:
        i = len(self.f)
        for a, b in ((self.f, 0), (self.t, np.inf), (self.l, i), (self.r, i), (self.v, value)):
            a.append(b)
        return i

    def flat(self, roots: list[int], depth: int, base: float = 0.0) -> Nodes:
        return Nodes(np.array(self.f, np.int32), np.array(self.t), np.array(self.l, np.int32), np.array(self.r, np.int32), np.array(self.v), np.array(roots), depth, base)


def boost(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0, least: int = 8) -> Nodes:
    """Boosted trees for the log-odds of ``y`` (0 or 1).

    ``monotone[j]`` = +1 / -1: the score never falls / rises as feature j grows.  A split that breaks it is not
    taken, and the children's values are kept on their side of the split's midpoint.
    """
    monotone, grower = monotone or {}, _Grower()
    p0 = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    if not len(y) or y.min() == y.max():
        return grower.flat([grower.leaf(0.0)], 1, base)
    cuts = _cuts(x, bins)
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # x <= cut -> bin <= its index
    f, roots = np.full(len(y), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        node = grower.leaf(rate * float(np.clip(-gs / (hs + l2), lo, hi)))
        if level == depth or len(rows) < 2 * least:
            return node
        best = (1e-6, None)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, j]
            n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
            vl, vr = -gl / (hl + l2), -(gs - gl) / (hs - hl + l2)
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            ok = (n >= least) & (len(rows) - n >= least)
            if j in monotone:
                ok &= monotone[j] * (vr - vl) >= 0
            gain = np.where(ok, gain, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (j, k, float(np.clip(vl[k], lo, hi)), float(np.clip(vr[k], lo, hi))))
        if best[1] is None:
            return node
        j, k, vl, vr = best[1]
        mid, way = (vl + vr) / 2, monotone.get(j, 0)
        left = binned[rows, j] <= k
        bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[way]
        grower.f[node], grower.t[node] = j, float(cuts[j][k])
        grower.l[node] = grow(rows[left], g, h, level + 1, *bounds[0])
        grower.r[node] = grow(rows[~left], g, h, level + 1, *bounds[1])
        return node

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        f = f + grower.flat([roots[-1]], depth).score(x)
    return grower.flat(roots, depth, base)


def decision_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Nodes:
    """A classification tree by Gini impurity over all midpoints; leaves hold the share of y = 1."""
    grower = _Grower()

    def grow(rows: np.ndarray, level: int) -> int:
        own = y[rows]
        node = grower.leaf(float(own.mean()))
        if level == depth or own.min() == own.max():
            return node
        best = (1e-9, 0, 0.0)
        total = own.mean() * (1 - own.mean()) * len(own)
        for j in range(x.shape[1]):
            v = x[rows, j]
            order = np.argsort(v, kind="stable")
            v, s = v[order], np.cumsum(own[order])
            n = np.arange(1, len(v))
            l1, r1 = s[:-1], s[-1] - s[:-1]
            gain = total - (l1 * (n - l1) / n + r1 * (len(v) - n - r1) / (len(v) - n))
            gain[(v[1:] == v[:-1]) | (n < least) | (len(v) - n < least)] = -1
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), j, float((v[k] + v[k + 1]) / 2))
        if best[0] <= 1e-9:
            return node
        _, j, t = best
        left = x[rows, j] <= t
        grower.f[node], grower.t[node] = j, t
        grower.l[node], grower.r[node] = grow(rows[left], level + 1), grow(rows[~left], level + 1)
        return node

    return grower.flat([grow(np.arange(len(y)), 0)], depth)
