"""Plane geometry of small point sets: hulls, areas, signed distances. Plain numpy, run per row or group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.expressions import shoelace


def signed_area2(points: np.ndarray) -> float:
    """Doubled area of a polygon's vertices, counter-clockwise positive."""
    x, y = np.asarray(points, float).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def _turn(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, counter-clockwise, without collinear ones."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p
    half = []
    for side in (p, p[::-1]):
        chain: list[np.ndarray] = []
        for q in side:
            while len(chain) > 1 and _turn(chain[-2], chain[-1], q) <= 0:
                chain.pop()
            chain.append(q)
        half.append(chain[:-1])
    return np.array(half[0] + half[1])


def area(points: np.ndarray) -> float:
    return abs(signed_area2(points)) / 2 if len(points) > 2 else 0.0


def close_ring(points: np.ndarray) -> np.ndarray:
    """The vertices with the first one again at the end."""
    p = np.asarray(points, float)
    return p if len(p) and (p[0] == p[-1]).all() else np.concatenate((p, p[:1]))


def collinear(points: np.ndarray) -> bool:
    """Whether all points lie on a line: along x (along y where x does not vary) no three consecutive ones span an area."""
    p = np.asarray(points, float)
    if len(p) < 3:
        return True
    p = p[np.lexsort((p[:, 1], p[:, 0]))] if np.ptp(p[:, 0]) else p[np.argsort(p[:, 1], kind="stable")]
    return all(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(t, (*t[1:], t[0]), strict=True)) == 0 for t in zip(p, p[1:], p[2:], strict=False))


def signed_distance(ring: np.ndarray, queries: np.ndarray, zero: float = 1e-12) -> np.ndarray:
    """Distance of each point to a convex polygon's outline: positive inside, negative outside, 0 within ``zero`` of it."""
    p = close_ring(ring)
    if signed_area2(p[:-1]) < 0:
        p = p[::-1]
    q = np.atleast_2d(np.asarray(queries, float))
    a, d = p[:-1], np.diff(p, axis=0)
    t = np.clip(((q[:, None] - a) * d).sum(axis=2) / (d * d).sum(axis=1), 0, 1)
    far = np.sqrt((((a + t[:, :, None] * d) - q[:, None]) ** 2).sum(axis=2)).min(axis=1)
    cross = d[:, 0] * (q[:, None, 1] - a[:, 1]) - d[:, 1] * (q[:, None, 0] - a[:, 0])
    out = np.where((cross >= 0).all(axis=1), far, -far)
    out[np.abs(out) < zero] = 0
    return out


class HullShape:
    """The convex hull of points: its vertices, area, and signed distances to its outline."""

    def __init__(self, points: Sequence[Sequence[float]]):
        self.vertices = hull(np.asarray(points, float))

    @property
    def area(self) -> float:
        return area(self.vertices)

    def ring(self) -> np.ndarray:
        return close_ring(self.vertices)

    def distances(self, queries: Sequence[Sequence[float]], zero: float = 1e-12) -> np.ndarray:
        return signed_distance(self.vertices, np.asarray(queries, float), zero)


def polygon_areas(rings: DataFrame, points: str = "points") -> DataFrame:
    """``rings`` with ``area`` of the array of (x, y) vertices."""
    return rings.withColumn("area", F.abs(shoelace(points)) / 2)


def _area3(x: list[Column], y: list[Column]) -> Column:
    return x[0] * y[1] - x[1] * y[0] + x[1] * y[2] - x[2] * y[1] + x[2] * y[0] - x[0] * y[2]


def collinear_groups(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, collinear) of point rows (x, y): fewer than three points, or no area between consecutive ones in order of (x, y)."""
    by = Window.partitionBy(*keys).orderBy("x", "y")
    before = [[F.lag(c, k).over(by) if k else F.col(c) for k in (2, 1, 0)] for c in ("x", "y")]
    rows = points.withColumn("a", _area3(*before))
    return rows.groupBy(*keys).agg(F.coalesce(F.bool_and(F.col("a") == 0), F.lit(True)).alias("collinear"))


def points_in_convex(points: DataFrame, ring: Sequence[Sequence[float]]) -> DataFrame:
    """``points`` (x, y, ...) with ``inside``: on or left of every edge of a counter-clockwise convex ring."""
    p = close_ring(np.asarray(ring, float))
    flags = [F.lit(bx - ax) * (F.col("y") - ay) - F.lit(by - ay) * (F.col("x") - ax) >= 0 for (ax, ay), (bx, by) in zip(p.tolist(), p[1:].tolist(), strict=False)]
    out = flags[0]
    for f in flags[1:]:
        out = out & f
    return points.withColumn("inside", out)


def distances_to_convex(points: DataFrame, ring: Sequence[Sequence[float]]) -> DataFrame:
    """``points`` (x, y, ...) with ``distance`` to the outline of a counter-clockwise convex ring, negative outside."""
    p = close_ring(np.asarray(ring, float)).tolist()
    sides, far = [], []
    for (ax, ay), (bx, by) in zip(p, p[1:], strict=False):
        dx, dy = bx - ax, by - ay
        x, y = F.col("x") - ax, F.col("y") - ay
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x * dx + y * dy) / (dx * dx + dy * dy)))
        sides.append(y * dx - x * dy >= 0)
        far.append((x - t * dx) * (x - t * dx) + (y - t * dy) * (y - t * dy))
    inside = sides[0]
    for side in sides[1:]:
        inside = inside & side
    least = F.sqrt(F.least(*far))
    return points.withColumn("distance", F.when(inside, least).otherwise(-least))


def hull_shapes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_vertices, area) of the convex hulls of point rows (x, y). Only the lowest and the highest point of every x can be a vertex: a group is as large as its distinct x."""
    ends = points.groupBy(*keys, "x").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    ends = ends.select(*keys, F.col("x").cast("double").alias("x"), F.explode(F.array_distinct(F.array(F.col("a").cast("double"), F.col("b").cast("double")))).alias("y"))
    names = list(keys)

    def shape(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        vertices = hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame([(*key, len(vertices), area(vertices))], columns=[*names, "n_vertices", "area"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema if f.name in names)
    return ends.groupBy(*keys).applyInPandas(shape, f"{fields}, n_vertices bigint, area double")
