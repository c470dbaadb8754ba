"""What the plots show, as tables: pixels in triangle coordinates, domain outlines, loop marks, colour limits. Drawing is left to the reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions.expressions import position_label
from foldspark.operators.intervals import overlaps_window
from foldspark.operators.matrix import KEY, region, symmetric
from foldspark.operators.scores import arrowhead as arrowhead_values


def triangle_coordinates(x: Column, y: Column) -> tuple[Column, Column]:
    """Grid points turned by half a right angle: along the diagonal, and height above it."""
    return (x + y) / 2, F.abs(y - x)


def triangle_cells(pixels: DataFrame) -> DataFrame:
    """``pixels`` with px and py, the turned coordinates of the cell's lower corner."""
    px, py = triangle_coordinates(F.col("bin1"), F.col("bin2"))
    return pixels.withColumns({"px": px.cast("double"), "py": py.cast("double")})


def triangle_outlines(domains: DataFrame, chrom: str, start: int, end: int, res: int) -> DataFrame:
    """Three corners (x1, x2, x3; y2 the height of the middle one; in bins from ``start``) of the domains in view, cut to it, that keep two bins at least."""
    rows = domains.where((F.col("chrom") == chrom) & (F.col("end") > start) & (F.col("start") < end))
    lo = F.floor((F.greatest(F.col("start"), F.lit(start)) - start) / res)
    hi = F.floor((F.least(F.col("end"), F.lit(end)) - start) / res)
    rows = rows.select("chrom", "start", "end", lo.alias("x1"), hi.alias("x3")).where("x3 - x1 >= 2")
    return rows.select("chrom", "start", "end", "x1", ((F.col("x1") + F.col("x3")) / 2).alias("x2"), "x3", (F.col("x3") - F.col("x1")).cast("double").alias("y2"))


def snap_loops(loops: DataFrame, pixels: DataFrame, res: int, around: int = 1) -> DataFrame:
    """``loops`` (chrom, start1, end1, start2, end2) with bin1, bin2, v: the strongest pixel of the square around the anchors, the first in row order of equal ones.

    Cells before the chromosome's begin do not exist; loops without any contact give no row.
    """
    side = F.sequence(F.lit(-around), F.lit(around))
    first = F.floor(F.col("start1") / res)
    second = F.floor(F.col("start2") / res)
    keys = ["chrom", "start1", "end1", "start2", "end2"]
    cells = loops.select(*keys, F.explode(F.transform(side, lambda k: first + k)).alias("x"), second.alias("c2")).select(*keys, "x", F.explode(F.transform(side, lambda k: F.col("c2") + k)).alias("y"))
    cells = cells.where("x >= 0 and y >= 0").select(*keys, F.least("x", "y").alias("bin1"), F.greatest("x", "y").alias("bin2"), "x", "y")
    found = cells.join(pixels.select("chrom", "bin1", "bin2", "v"), ["chrom", "bin1", "bin2"])
    best = found.groupBy(*keys).agg(F.max(F.struct("v", (-F.col("x")).alias("a"), (-F.col("y")).alias("b"))).alias("m"))
    return best.select(*keys, (-F.col("m.a")).alias("bin1"), (-F.col("m.b")).alias("bin2"), F.col("m.v").alias("v"))


def color_limit(pixels: DataFrame, share: float = 0.95) -> DataFrame:
    """The quantile of the (symmetric) non-zero values at which the colours end."""
    return symmetric(pixels).where("v <> 0").groupBy(*KEY).agg(F.percentile("v", F.lit(share)).alias("vmax"))


def labelled(domains: DataFrame) -> DataFrame:
    """``domains`` with the labels of their ends."""
    return domains.withColumns({"start_label": position_label("start"), "end_label": position_label("end")})


def chromosome_view(
    pixels: DataFrame, domains: DataFrame, track: DataFrame, chrom: str, res: int, *,
    start: int | None = None, end: int | None = None, arrowhead: bool = False, vmin: float | None = None, vmax: float | None = None,
) -> dict[str, DataFrame]:
    """The tables of a plot of a chromosome, or of its stretch from ``start`` to ``end``: cells (contacts or arrowhead values, both triangles), boxes by level (outermost or nested) that
    overlap the view, outlines cut to it, track, and the limits of the colours."""
    lo, hi = start or 0, end if end is not None else 2**62
    own = pixels.where(F.col("chrom") == chrom)
    inside = region(own, lo // res, min(-(-hi // res), 2**62))
    boxes = overlaps_window(domains, chrom, lo, hi).withColumn("outer", F.col("level") == 0)
    cells = symmetric(inside)
    if arrowhead:
        whole = inside.groupBy(*KEY).agg(F.lit(lo // res).cast("bigint").alias("start_bin"), (F.max("bin2") + 1).alias("end_bin"))
        got = arrowhead_values(own, whole).select(*KEY, F.col("x").alias("bin1"), F.col("y").alias("bin2"), F.col("a").alias("v"))
        cells = symmetric(got)
    limit = color_limit(inside).select(*KEY, F.lit(0.0 if vmin is None else vmin).alias("vmin"), F.col("vmax") if vmax is None else F.lit(vmax).alias("vmax"))
    seen = track.where((F.col("chrom") == chrom) & (F.col("end") > lo) & (F.col("start") < hi))
    last = min(hi, 2**40)
    return {"cells": cells, "boxes": labelled(boxes), "outlines": triangle_outlines(domains, chrom, lo, last, res), "track": seen, "limit": limit}
