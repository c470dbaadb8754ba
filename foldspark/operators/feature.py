"""Aggregation preference of a domain: which contacts exceed their local background, how they cluster, how dense the clusters are. Plain numpy, one domain at a time."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from foldspark.operators.geometry import area, collinear, hull


def drop_empty(matrix: np.ndarray, left: int = 0) -> tuple[np.ndarray, dict[int, int]]:
    """The matrix without its empty rows and columns, and the old index (from ``left``) of each new one."""
    full = np.flatnonzero(matrix.any(axis=0))
    return matrix[np.ix_(full, full)], {i: int(b) + left for i, b in enumerate(full)}


def cubic_through(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The not-a-knot cubic spline through (x, y); straight lines between fewer than four points."""
    n = len(x)
    if n < 4:
        return np.interp(at, x, y)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    u, w = at - x[k], x[k + 1] - at
    return (m[k] * w**3 + m[k + 1] * u**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * w + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * u


def smooth_decay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Decay over distance by a spline through evenly spread points; after its first turn from falling to rising it holds its value."""
    n = len(x)
    if n < 2:
        return y.astype(float)
    # every third, else every second point where more than six are left
    few = n / 3 if n / 3 > 6 else n / 2 if n / 2 > 6 else n
    xi = np.linspace(x.min(), x.max(), int(few))
    out = cubic_through(xi, np.interp(xi, x, y), x.astype(float))
    slope = np.gradient(out)
    turned = (slope[:-1] <= 0) & (slope[1:] >= 0)
    hold = int(turned.argmax()) if turned.any() else n - 1
    return out[np.minimum(np.arange(n), hold)]


def _boxes(m: np.ndarray, reach: int) -> np.ndarray:
    """``total[i, j]``: sum of m over rows < i - reach and columns < j - reach of the padded matrix, for window sums."""
    p = np.pad(m, reach)
    return np.pad(p.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))


def _sum(total: np.ndarray, n: int, reach: int, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
    """Sums over row offsets r0 .. r1 and column offsets c0 .. c1 for all cells."""
    take = lambda r, c: total[reach + r : reach + r + n, reach + c : reach + c + n]
    return take(r1 + 1, c1 + 1) - take(r0, c1 + 1) - take(r1 + 1, c0) + take(r0, c0)


def _quadrants(m: np.ndarray, reach: int, w: int) -> np.ndarray:
    """Sums of the (2w + 1)^2 square around each cell without its middle row and column."""
    total, n = _boxes(m, reach), len(m)
    sides = ((-w, -1), (1, w))
    return sum(_sum(total, n, reach, *r, *c) for r in sides for c in sides)


def poisson_tail(k: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """P(X > floor(k)) by cell; NaN where mu is not positive."""
    out = np.full(k.shape, np.nan)
    for i in np.flatnonzero(mu > 0):
        m, top = float(mu.flat[i]), math.floor(k.flat[i])
        if top < 0:
            out.flat[i] = 1.0
            continue
        j = np.arange(top + 1)
        logs = j * math.log(m) - m - np.cumsum(np.log(np.maximum(j, 1)))
        peak = logs.max()
        out.flat[i] = max(0.0, 1.0 - math.exp(peak) * float(np.exp(logs - peak).sum()))
    return out


def dbscan(points: np.ndarray, eps: float, min_points: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, core flags): clusters numbered in order of their first core point, -1 for noise; a border point goes to the cluster that reaches it first."""
    d2 = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    near = d2 <= eps * eps
    core = near.sum(axis=1) >= min_points
    label = np.full(len(points), -1)
    n = 0
    for i in range(len(points)):
        if label[i] != -1 or not core[i]:
            continue
        label[i], todo = n, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & (label == -1)):
                label[j] = n
                if core[j]:
                    todo.append(int(j))
        n += 1
    return label, core


@dataclass
class DomainMap:
    """A domain's matrix: rescaled, without gaps, with its smoothed decay; then its significant cells and their clusters."""

    matrix: np.ndarray
    left: int = 0
    points: np.ndarray = field(default_factory=lambda: np.empty((0, 2), int))
    labels: np.ndarray = field(default_factory=lambda: np.empty(0, int))
    clusters: list[dict] = field(default_factory=list)
    cells: int = 0

    def __post_init__(self) -> None:
        m = np.asarray(self.matrix, float)
        full = m[m != 0]
        if len(full) and np.median(full) < 1:
            m = m / full.min()
        self.m, self.index = drop_empty(m, self.left)
        means = np.array([np.diagonal(self.m, k).mean() for k in range(len(self.m))])
        self.first = int(np.argmax(means > 0)) if (means > 0).any() else 0
        self.decay = smooth_decay(np.arange(self.first, len(self.m)), means[self.first :])

    def significant_cells(self, pw: int = 2, ww: int = 5, top: float = 0.7, ratio: float = 0.05) -> np.ndarray:
        """Cells that exceed their donut background most: of the ``top`` share by blurred signal the ``ratio`` share (of all) by p-value."""
        n = len(self.m)
        start = max(ww, self.first)
        i, j = np.triu_indices(n, start)
        upper, blur = np.triu(self.m, start), np.triu(self.m)
        expected = np.zeros((n, n))
        expected[i, j] = self.decay[j - i - self.first]
        seen = _quadrants(upper, ww, ww) - _quadrants(upper, ww, pw)
        hoped = _quadrants(expected, ww, ww) - _quadrants(expected, ww, pw)
        tiny = 1e-9 * max(1.0, float(np.abs(upper).sum()))
        seen[np.abs(seen) < tiny] = 0
        hoped = np.where(np.abs(hoped) < 1e-9 * max(1.0, float(expected.sum())), 1.0, hoped)
        self.corrected = expected * seen / hoped
        some = blur.any(axis=0).astype(float)
        counts = _sum(_boxes(np.outer(some, some), pw), n, pw, -pw, pw, -pw, pw)
        sums = _sum(_boxes(blur, pw), n, pw, -pw, pw, -pw, pw)
        blurred = np.where(counts > 0.5, sums / np.maximum(counts, 1), 0.0)
        self.fold = np.divide(upper, self.corrected, out=np.zeros((n, n)), where=self.corrected != 0)
        p = poisson_tail(upper[i, j], self.corrected[i, j])
        self.cells = len(i)
        order = np.lexsort((j, i, blurred[i, j]))[int(math.floor((1 - top) * len(i))) :]
        order = order[~np.isnan(p[order])]
        order = order[np.lexsort((j[order], i[order], p[order]))][: math.ceil(ratio / top * len(order))]
        self.points = np.column_stack((i[order], j[order]))
        return self.points

    def parameters(self) -> tuple[float, int]:
        """(eps, MinPts) of the clustering from the points' number and bounding box."""
        m = len(self.points)
        min_points = math.ceil(m / 25) + 1
        box = np.ptp(self.points, axis=0).astype(float).prod()
        return math.sqrt(box * min_points / (m * math.pi)), min_points

    def cluster(self) -> None:
        """Clusters of the points; lone ones are dropped."""
        self.labels, self.clusters = np.full(len(self.points), -1), []
        if len(self.points) < 5:
            return
        eps, k = self.parameters()
        label, core = dbscan(self.points.astype(float), max(eps, math.sqrt(2)), k)
        size = np.bincount(label[label >= 0], minlength=1)
        keep = (label < 0) | (size[np.maximum(label, 0)] > 1)
        number = np.cumsum(size > 1) - 1
        self.points, core, label = self.points[keep], core[keep], label[keep]
        self.labels = np.where(label < 0, -1, number[np.maximum(label, 0)])
        for c in range(int(self.labels.max(initial=-1)) + 1):
            own = self.points[self.labels == c].astype(float)
            d = np.sqrt(((self.points[(self.labels == c) & core][:, None] - own[None]) ** 2).sum(axis=2))
            near = np.sort(d, axis=1)[:, 1:k].sum(axis=1)
            flat_ = collinear(own)
            self.clusters.append(
                {"size": len(own), "radius": float((near / (k - 1)).mean()), "density": float(((k - 1) / near).mean()), "area": 0.0 if flat_ else area(hull(own)), "collinear": flat_}
            )

    def mean_density(self) -> float:
        """Densities weighted by the clusters' shares of clustered points; 0 without clusters."""
        total = sum(c["size"] for c in self.clusters)
        return sum(c["density"] * c["size"] / total for c in self.clusters) if total else 0.0

    def cover(self) -> float:
        """Hull areas by tested cells."""
        return sum(c["area"] for c in self.clusters) / self.cells if self.cells else 0.0

    def restored(self, m: np.ndarray) -> np.ndarray:
        """A gap-free matrix back at its bins."""
        n = max(self.index.values(), default=-1) - self.left + 1
        out = np.zeros((n, n))
        at = np.array([self.index[k] - self.left for k in range(len(m))], int)
        out[np.ix_(at, at)] = m
        return out


def domain_feature(matrix: np.ndarray, *, pw: int = 2, ww: int = 5, top: float = 0.7, ratio: float = 0.05, gap: float = 0.2) -> dict:
    """ap (-1 for a domain that is too gappy or small), gap_ratio, cover, and counts of points and clusters."""
    m = np.nan_to_num(np.asarray(matrix, float))
    kept = int(m.any(axis=0).sum())
    gaps = 1 - kept / len(m) if len(m) else 1.0
    out = {"ap": -1.0, "gap_ratio": gaps, "cover": 0.0, "n_points": 0, "n_clusters": 0}
    if gaps < gap and kept > 2 * ww + 1:
        own = DomainMap(m)
        own.significant_cells(pw, ww, top, ratio)
        own.cluster()
        out |= {"ap": own.mean_density(), "cover": own.cover(), "n_points": len(own.points), "n_clusters": len(own.clusters)}
    return out
