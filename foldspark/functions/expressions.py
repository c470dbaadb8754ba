"""Scalar expressions over intervals, positions and values. All are null-safe in the sense of SQL: a null argument gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chi-square with three degrees of freedom reaches p = 0.05 here.
CHI2_3DF_05 = 7.814727903251179


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def overlap_ratio(s1, e1, s2, e2) -> Column:
    """Intersection by union of two half-open intervals; 0 where they are apart or only touch."""
    s1, e1, s2, e2 = map(_c, (s1, e1, s2, e2))
    inter = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / (F.greatest(e1, e2) - F.least(s1, s2)).cast("double"))


def intersect_start(s1, s2) -> Column:
    return F.greatest(_c(s1), _c(s2))


def intersect_end(e1, e2) -> Column:
    return F.least(_c(e1), _c(e2))


def bin_of(pos, res: int) -> Column:
    """Bin of a position (integer division)."""
    return F.floor(_c(pos) / F.lit(res)).cast("bigint")


def position_of(bin_, res: int) -> Column:
    return _c(bin_) * F.lit(res)


def strip_prefix(chrom, prefix: str = "chr") -> Column:
    """The name without a leading prefix."""
    return F.when(F.startswith(_c(chrom), F.lit(prefix)), F.substring(_c(chrom), len(prefix) + 1, 1 << 20)).otherwise(_c(chrom))


def force_prefix(chrom, prefix: str = "chr") -> Column:
    """The name with the prefix exactly once."""
    return F.concat(F.lit(prefix), strip_prefix(chrom, prefix))


def position_label(pos) -> Column:
    """``12M345K``; without a zero part, and ``0K`` for positions below one kilobase."""
    pos = _c(pos).cast("bigint")
    mega, kilo = F.floor(pos / 1_000_000).cast("string"), F.floor((pos % 1_000_000) / 1000).cast("string")
    return F.when(mega == "0", F.concat(kilo, F.lit("K"))).when(kilo == "0", F.concat(mega, F.lit("M"))).otherwise(F.concat(mega, F.lit("M"), kilo, F.lit("K")))


def midpoint_normalize(value, vmin: float, vmax: float, midpoint: float) -> Column:
    """Piecewise linear to [0, 0.5, 1], held at the ends; half of the range where the midpoint lies outside; 0.5 for an empty range."""
    value = _c(value)
    if vmin == vmax:
        return F.lit(0.5)
    if vmin < midpoint < vmax:
        low = (value - vmin) / (midpoint - vmin) * 0.5
        high = (value - midpoint) / (vmax - midpoint) * 0.5 + 0.5
        inner = F.when(value <= midpoint, low).otherwise(high)
        lo, hi = 0.0, 1.0
    else:
        lo, hi = (0.5, 1.0) if vmin >= midpoint else (0.0, 0.5)
        inner = (value - vmin) / (vmax - vmin) * 0.5 + lo
    return F.when(value <= vmin, F.lit(lo)).when(value >= vmax, F.lit(hi)).otherwise(inner)


def poisson_upper_tail(k, mu) -> Column:
    """P(X > floor(k)) for X of mean ``mu``; null where ``mu`` is not positive. Terms are summed in log space, so large means do not underflow early."""
    k, mu = F.floor(_c(k)).cast("int"), _c(mu).cast("double")
    terms = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k, F.lit(0))),
        F.struct(F.lit(0.0).alias("s"), (-mu).alias("t")),
        lambda a, i: F.struct((a["s"] + F.exp(a["t"])).alias("s"), (a["t"] + F.log(mu) - F.log((i + 1).cast("double"))).alias("t")),
        lambda a: a["s"],
    )
    return F.when(mu <= 0, F.lit(None).cast("double")).when(k < 0, F.lit(1.0)).otherwise(F.greatest(1 - terms, F.lit(0.0)))


def fold_enrichment(obs, expected) -> Column:
    """obs / expected, 0 where expected is 0."""
    return F.coalesce(F.try_divide(_c(obs).cast("double"), _c(expected).cast("double")), F.lit(0.0))


def shoelace(points) -> Column:
    """Signed doubled area of an array of (x, y) vertices, counter-clockwise positive; summed plainly in vertex order."""
    p = _c(points)
    n = F.size(p)
    at = lambda i: F.element_at(p, (i % n + 1).cast("int"))
    return F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0.0),
        lambda a, i: a + at(i)["x"].cast("double") * at(i + 1)["y"].cast("double") - at(i + 1)["x"].cast("double") * at(i)["y"].cast("double"),
    )


def chi2_transitions(n00, n01, n10, n11) -> Column:
    """Chi-square of four transition counts against equal ones; null where there are none."""
    counts = [_c(x).cast("double") for x in (n00, n01, n10, n11)]
    mean = (counts[0] + counts[1] + counts[2] + counts[3]) / 4
    return sum((F.try_divide((c - mean) * (c - mean), mean) for c in counts[1:]), F.try_divide((counts[0] - mean) * (counts[0] - mean), mean))


def levels_compatible(levels) -> Column:
    """Whether the least inner boundary level is at least the larger of the outer two; true for up to two boundaries."""
    a = _c(levels)
    inner = F.array_min(F.slice(a, 2, F.greatest(F.size(a) - 2, F.lit(1))))
    return F.when(F.size(a) <= 2, F.lit(True)).otherwise(inner >= F.greatest(F.element_at(a, 1), F.element_at(a, -1)))


def is_number(value) -> Column:
    """Whether a string is a number."""
    return F.expr(f"try_cast({value} AS DOUBLE) IS NOT NULL") if isinstance(value, str) else value.try_cast("double").isNotNull()
