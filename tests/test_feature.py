"""Features and geometry: goldens, brute force, planted spots."""

import numpy as np
import pytest

from foldspark.operators import feature as f
from foldspark.operators import geometry as g


def symmetric(n, seed=0, mean=3.0):
    m = np.triu(np.random.default_rng(seed).poisson(mean, (n, n)).astype(float))
    return m + np.triu(m, 1).T


def test_geometry():
    kite = np.array([(0, 0), (3, -2), (7, 0), (3, 5)], float)
    assert g.signed_area2(kite) == 49.0 and g.signed_area2(kite[::-1]) == -49.0
    steep = np.array([(1, 1), (2, 4), (5, 13), (11, 31)], float)
    assert g.collinear(steep) and g.collinear(steep[::-1] * (0, 1) + (6, 0)) and not g.collinear(kite)
    shape = g.HullShape([*kite.tolist(), (3, 0), (2, 1), (5, 0), (3, -2)])
    assert sorted(map(tuple, shape.vertices)) == sorted(map(tuple, kite)) and shape.area == 24.5
    # inside, on an edge, beyond a corner, on a corner; the corner (7, 0) is 5 away from (11, 3)
    got = shape.distances([(3, 0), (1.5, -1), (11, 3), (3, 5)])
    assert got[0] > 0 and got[1] == 0 and got[2] == pytest.approx(-5.0) and got[3] == 0
    assert len(shape.ring()) == 5 and (shape.ring()[0] == shape.ring()[-1]).all()


def test_signed_distance_brute():
    rng = np.random.default_rng(1)
    for _ in range(20):
        shape = g.HullShape(rng.normal(size=(12, 2)))
        ring, q = shape.ring(), rng.normal(size=(30, 2)) * 1.5
        edge = np.concatenate([a + np.linspace(0, 1, 4001)[:, None] * (b - a) for a, b in zip(ring, ring[1:])])
        far = np.sqrt(((q[:, None] - edge[None]) ** 2).sum(axis=2)).min(axis=1)
        inside = [all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(ring, ring[1:])) for x, y in q]
        assert np.allclose(shape.distances(q), np.where(inside, far, -far), atol=2e-3)


def test_small_functions():
    m = np.zeros((4, 4))
    m[np.ix_([0, 2, 3], [0, 2, 3])] = 1
    new, index = f.drop_empty(m)
    assert len(new) == 3 and index == {0: 0, 1: 2, 2: 3}
    assert f.poisson_tail(np.array([3.7]), np.array([2.0]))[0] == pytest.approx(0.142877, abs=1e-6)
    assert np.isnan(f.poisson_tail(np.array([1.0]), np.array([0.0]))[0])
    x = np.linspace(0, 3, 9)
    at = np.linspace(0, 3, 31)
    assert np.allclose(f.cubic_through(x, x**3 - 2 * x, at), at**3 - 2 * at)
    c = f.DomainMap(symmetric(20))
    c.points = np.column_stack((np.arange(50) % 11, np.arange(50) % 21))
    assert c.parameters() == (pytest.approx(1.954410, abs=1e-6), 3)


def test_stencils_against_loops():
    n, ww, pw = 30, 5, 2
    u = np.triu(symmetric(n), ww)
    want = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            for a in range(-ww, ww + 1):
                for b in range(-ww, ww + 1):
                    if a and b and not (abs(a) <= pw and abs(b) <= pw) and 0 <= i + a < n and 0 <= j + b < n:
                        want[i, j] += u[i + a, j + b]
    assert np.allclose(f._quadrants(u, ww, ww) - f._quadrants(u, ww, pw), want)


def test_planted_spot():
    m = symmetric(40, mean=5)
    m[8:12, 28:32] += 60
    m[28:32, 8:12] += 60
    out = f.domain_feature(m)
    core = f.DomainMap(m)
    core.significant_cells()
    assert out["ap"] > 0 and out["n_clusters"] >= 1
    assert ((abs(core.points[:, 0] - 10) <= 3) & (abs(core.points[:, 1] - 30) <= 3)).sum() >= 8


def test_rejected():
    assert f.domain_feature(np.zeros((30, 30)))["ap"] == -1 and f.domain_feature(symmetric(8))["ap"] == -1
    gappy = symmetric(40)
    gappy[::3] = 0
    gappy[:, ::3] = 0
    assert f.domain_feature(gappy)["ap"] == -1 and f.domain_feature(gappy)["gap_ratio"] == pytest.approx(14 / 40)
    assert f.domain_feature(np.zeros((0, 0)))["gap_ratio"] == 1.0


def test_restore():
    m = symmetric(20)
    m[5] = m[:, 5] = 0
    c = f.DomainMap(m)
    assert c.restored(c.m).shape == (20, 20) and not c.restored(c.m)[5].any()


def test_dbscan_brute():
    rng = np.random.default_rng(3)
    p = rng.integers(0, 30, (60, 2)).astype(float)
    label, core = f.dbscan(p, 3.0, 4)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    assert (core == ((d <= 3).sum(1) >= 4)).all()
    for i in range(60):
        for j in range(60):
            if core[i] and core[j] and d[i, j] <= 3:
                assert label[i] == label[j]
        assert (label[i] == -1) == (not (core & (d[i] <= 3)).any())
