"""Interval sets as tables: columns set_id, chrom, start, end, level (base pairs, half-open, level 0 outermost).

Containment and overlap are equi-joins on coarse position buckets, not nested loops: a container is sent to every bucket it covers, a member to that of its start.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.expressions import intersect_end, intersect_start, overlap_ratio

SET = ["set_id", "chrom"]
#: Base pairs of a bucket.
BUCKET = 1_000_000


def _as(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def contained(inner: DataFrame, outer: DataFrame, *, bucket: int = BUCKET, by: tuple[str, ...] = ("set_id", "chrom")) -> DataFrame:
    """Pairs with inner.start >= outer.start and inner.end <= outer.end: columns of inner, and those of outer with prefix ``o_``."""
    big = _as(outer, "o_", by).withColumn("_b", F.explode(F.sequence(F.floor(F.col("o_start") / bucket), F.floor((F.col("o_end") - 1) / bucket))))
    small = inner.withColumn("_b", F.floor(F.col("start") / bucket))
    return small.join(big, [*by, "_b"]).where("start >= o_start and end <= o_end").drop("_b")


def overlapping(one: DataFrame, two: DataFrame, *, bucket: int = BUCKET, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Pairs that share a position: columns of one, and those of two with prefix ``o_``; each pair once, in its first common bucket."""
    spread = lambda df, s, e: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor((F.col(e) - 1) / bucket))))
    both = spread(one, "start", "end").join(spread(_as(two, "o_", by), "o_start", "o_end"), [*by, "_b"])
    first = F.floor(F.greatest("start", "o_start") / bucket)
    return both.where("end > o_start and start < o_end").where(F.col("_b") == first).drop("_b")


def overlaps_window(domains: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    return domains.where((F.col("chrom") == chrom) & (F.col("end") > start) & (F.col("start") < end))


def at_least(domains: DataFrame, bins: int, res: int) -> DataFrame:
    return domains.where(F.col("end") - F.col("start") >= bins * res)


def noise_filter(domains: DataFrame, most: float = 0.5) -> DataFrame:
    return domains.where(F.col("noise") <= most)


def nested_levels(domains: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """Distinct intervals with level = number of other distinct intervals of the set and chromosome that contain each."""
    rows = domains.select(*SET, "start", "end").distinct()
    pairs = contained(rows, rows, bucket=bucket)
    return pairs.groupBy(*SET, "start", "end").agg((F.count("*") - 1).alias("level"))


def boundary_levels(domains: DataFrame, res: int) -> DataFrame:
    """(pos, level): the least level of the domains (five bins at least) that begin or end there."""
    rows = at_least(domains, 5, res)
    return rows.select(*SET, F.explode(F.array("start", "end")).alias("pos"), "level").groupBy(*SET, "pos").agg(F.min("level").alias("level"))


def children(domains: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """(start, end, level, c_start, c_end, c_level): domains one level deeper inside each."""
    pairs = contained(domains.select(*SET, "start", "end", "level"), domains.select(*SET, "start", "end", "level"), bucket=bucket)
    return pairs.where("level = o_level + 1").select(
        *SET, F.col("o_start").alias("start"), F.col("o_end").alias("end"), F.col("o_level").alias("level"), F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("level").alias("c_level")
    )


def leaves(domains: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    return domains.join(children(domains, bucket=bucket).select(*SET, "start", "end", "level").distinct(), [*SET, "start", "end", "level"], "left_anti")


def leaf_roots(domains: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """(start, end, level, root_start, root_end) of leaves with the level-0 domain around them."""
    pairs = contained(leaves(domains, bucket=bucket).select(*SET, "start", "end", "level"), domains.where("level = 0").select(*SET, "start", "end"), bucket=bucket)
    return pairs.select(*SET, "start", "end", "level", F.col("o_start").alias("root_start"), F.col("o_end").alias("root_end"))


def region_domains(domains: DataFrame, start: int, end: int, level: int | None = None, *, bucket: int = BUCKET) -> DataFrame:
    """Domains inside [start, end]; with ``level``, of each leaf's chain that of the level, or the deepest where the chain ends above it."""
    rows = domains.select(*SET, "start", "end", "level")
    inside = rows.where((F.col("start") >= start) & (F.col("end") <= end))
    if level is None:
        return inside.distinct()
    chains = contained(leaves(rows, bucket=bucket), inside, bucket=bucket)
    deepest = F.max("o_level").over(Window.partitionBy(*SET, "start", "end"))
    own = chains.withColumn("deepest", deepest).where((F.col("o_level") == level) | ((F.col("deepest") < level) & (F.col("o_level") == F.col("deepest"))))
    return own.select(*SET, F.col("o_start").alias("start"), F.col("o_end").alias("end"), F.col("o_level").alias("level")).distinct()


def boundaries(domains: DataFrame, res: int) -> DataFrame:
    """(chrom, pos, idx): a set's boundaries, numbered by position."""
    rows = boundary_levels(domains, res)
    at = F.row_number().over(Window.partitionBy(*SET).orderBy("pos")) - 1
    return rows.select(*SET, "pos", at.cast("bigint").alias("idx"))


def nearest_boundaries(points: DataFrame, bounds: DataFrame, tolerance: int) -> DataFrame:
    """``points`` (chrom, pos) with nearest, first_idx, last_idx among ``bounds`` (chrom, pos, idx) of one set; chromosomes without bounds give no row.

    Two sorts of both lists: the bounds before and after each point, and the outermost ones within ``tolerance``, come from running aggregates. All frames begin at the first row or are
    short: one up to the last row would be gone through again for every row.
    """
    rows = points.select("chrom", "pos").distinct()
    sizes = bounds.groupBy("chrom").agg(F.count("*").alias("n"))
    marks = (
        bounds.select("chrom", "pos", "idx", F.lit(0).alias("kind"))
        .unionByName(rows.select("chrom", "pos", F.lit(None).cast("bigint").alias("idx"), F.lit(1).alias("kind")))
        .withColumn("b", F.when(F.col("kind") == 0, F.struct("idx", "pos")))
    )
    before, after = (Window.partitionBy("chrom").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow) for by in (("pos", "kind"), (F.desc("pos"), "kind")))
    # bounds nearer than the tolerance: positions are whole numbers
    near = Window.partitionBy("chrom").orderBy("pos").rangeBetween(-(tolerance - 1), tolerance - 1)
    got = marks.select(
        "chrom", "pos", "kind", F.last("b", True).over(before).alias("left"), F.last("b", True).over(after).alias("right"), F.min("idx").over(near).alias("lo"), F.max("idx").over(near).alias("hi")
    ).where("kind = 1")
    got = got.join(sizes, "chrom").withColumn("l", F.coalesce("left", "right")).withColumn("r", F.coalesce("right", "left"))
    got = got.withColumn("lo", F.least(F.coalesce("lo", "l.idx"), "l.idx")).withColumn("hi", F.greatest(F.coalesce("hi", "r.idx"), "r.idx"))
    nearest = F.when(F.abs(F.col("pos") - F.col("r.pos")) < F.abs(F.col("pos") - F.col("l.pos")), F.col("r.pos")).otherwise(F.col("l.pos"))
    return got.select(
        "chrom", "pos", nearest.alias("nearest"), F.greatest(F.col("lo") - 1, F.lit(0)).alias("first_idx"), F.least(F.col("hi") + 1, F.col("n") - 1).alias("last_idx")
    )


def _by_chrom(target: DataFrame, query: DataFrame, run: Callable[..., list[np.ndarray]], added: str) -> DataFrame:
    """What ``run`` gives for the starts and ends of a chromosome's targets and those of its queries: bigint columns and, named with a type, others. A group holds arrays of the positions of one chromosome."""
    one, two = (d.where("chrom IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").select(F.col("chrom").alias("chrom"), *[F.col(c).cast("bigint").alias(c) for c in ("start", "end")]) for d in (target, query))
    names = [c.split()[0] for c in added.split(", ")]

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        got = run(*[d.column(c).to_numpy() for d in (left, right) for c in ("start", "end")])
        chrom = (left if left.num_rows else right).column("chrom")[0]
        return pa.table({"chrom": pa.repeat(chrom, len(got[0])), **{c: pa.array(x) for c, x in zip(names, got, strict=True)}})

    schema = f"chrom {target.schema['chrom'].dataType.simpleString()}, " + ", ".join(c if " " in c else f"{c} bigint" for c in added.split(", "))
    return one.groupBy("chrom").cogroup(two.groupBy("chrom")).applyInArrow(group, schema)


def _distinct(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct intervals by start and end."""
    order = np.lexsort((end, start))
    start, end = start[order], end[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new]


def best_stretches(start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit_start, hit_end, ratio) of intervals: the stretch between two of the sorted ``bounds`` that overlaps each best, of equal ones the last; ratio 0 where none does.

    The overlap grows while an end of the stretch comes nearer to that of the interval, from either side. So the best stretch begins at the last bound up to the interval's start or at the
    first from there on, and ends in the same way: four stretches are compared, however many bounds the interval holds.
    """
    hit_start, hit_end, best = np.zeros_like(start), np.zeros_like(end), np.zeros(len(start))
    if len(bounds):
        around = lambda p: (bounds[np.maximum(np.searchsorted(bounds, p, "right") - 1, 0)], bounds[np.minimum(np.searchsorted(bounds, p), len(bounds) - 1)])
        ends = around(end)
        for s in around(start):
            for e in ends:
                inter = np.minimum(end, e) - np.maximum(start, s)
                ratio = np.where(inter > 0, inter, 0) / np.maximum(np.maximum(end, e) - np.minimum(start, s), 1)
                better = (ratio > 0) & (ratio >= best)
                hit_start, hit_end, best = np.where(better, s, hit_start), np.where(better, e, hit_end), np.where(better, ratio, best)
    return hit_start, hit_end, best


def _bounds(start: np.ndarray, end: np.ndarray, res: int) -> np.ndarray:
    """The sorted boundaries of the domains of five bins at least."""
    wide = end - start >= 5 * res
    return np.unique(np.concatenate((start[wide], end[wide])))


def best_spans(domains: DataFrame, query: DataFrame, res: int) -> DataFrame:
    """``domains`` (chrom, start, end) with hit_start, hit_end and ratio: the stretch between two query boundaries near its ends that overlaps it best.

    Of equal ones that with the largest boundary list wins: the one that begins last, then the one that ends last. Domains without a hit give no row.
    """

    def run(start: np.ndarray, end: np.ndarray, q_start: np.ndarray, q_end: np.ndarray) -> list[np.ndarray]:
        start, end = _distinct(start, end)
        got = [start, end, *best_stretches(start, end, _bounds(q_start, q_end, res))]
        return [x[got[-1] > 0] for x in got]

    return _by_chrom(domains, query, run, "start, end, hit_start, hit_end, ratio double")


def _inside(start: np.ndarray, end: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (k, m): the interval m, of those sorted by ``start``, lies in the stretch k from s to e."""
    low = np.searchsorted(start, s)
    n = np.maximum(np.searchsorted(start, e) - low, 0)
    k = np.repeat(np.arange(len(s)), n)
    m = np.arange(len(k)) - np.repeat(np.cumsum(n) - n - low, n)
    ok = end[m] <= e[k]
    return k[ok], m[ok]


def _mutual(t: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray], res: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``t`` and ``q`` (distinct, sorted) of all pairs with either domain in the best stretch of the other."""
    found = []
    for one, two in ((t, q), (q, t)):
        hit_start, hit_end, ratio = best_stretches(*one, _bounds(*two, res))
        hit_end = np.where(ratio > 0, hit_end, hit_start)
        found.append(_inside(*two, hit_start, hit_end))
    (a, b), (d, c) = found
    both = np.intersect1d(a * len(q[0]) + b, c * len(q[0]) + d)
    return both // max(len(q[0]), 1), both % max(len(q[0]), 1)


def _wide(start: np.ndarray, end: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """The domains of five bins at least, by start."""
    keep = np.flatnonzero(end - start >= 5 * res)
    keep = keep[np.argsort(start[keep], kind="stable")]
    return start[keep], end[keep]


def mutual_edges(target: DataFrame, query: DataFrame, res: int) -> DataFrame:
    """(t_start, t_end, q_start, q_end, ratio): members of a target's best span that have the target in theirs."""

    def run(*ends: np.ndarray) -> list[np.ndarray]:
        t, q = (_distinct(*_wide(*x, res)) for x in (ends[:2], ends[2:]))
        a, b = _mutual(t, q, res)
        return [t[0][a], t[1][a], q[0][b], q[1][b]]

    both = _by_chrom(target, query, run, "t_start, t_end, q_start, q_end")
    return both.withColumn("ratio", overlap_ratio("t_start", "t_end", "q_start", "q_end"))


def region_pairs(target: DataFrame, query: DataFrame, res: int, *, bucket: int = BUCKET) -> DataFrame:
    """(t_start, t_end, q_start, q_end, n_target, n_query): connected groups of single-level domains of both sets, with the domains in each region. ``bucket`` is of no use any more."""
    from foldspark.operators.graph import least_nodes

    def run(*ends: np.ndarray) -> list[np.ndarray]:
        sides = [_wide(*x, res) for x in (ends[:2], ends[2:])]
        t, q = (_distinct(*x) for x in sides)
        a, b = _mutual(t, q, res)
        _, part = np.unique(least_nodes(a, b + len(t[0]), len(t[0]) + len(q[0]))[a], return_inverse=True)
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        edge = lambda f, x: f.reduceat(x[order], first) if len(first) else x[:0]
        out = [edge(f, x) for x, f in ((t[0][a], np.minimum), (t[1][a], np.maximum), (q[0][b], np.minimum), (q[1][b], np.maximum))]
        return out + [np.bincount(_inside(*x, *out[k : k + 2])[0], minlength=len(first)) for x, k in zip(sides, (0, 2), strict=True)]

    return _by_chrom(target, query, run, "t_start, t_end, q_start, q_end, n_target, n_query")


def pair_classes(pairs: DataFrame) -> DataFrame:
    """``pairs`` with class: conserved (1:1), merged (n:1), split (1:n) or complex."""
    one, other = F.col("n_target") == 1, F.col("n_query") == 1
    name = F.when(one & other, "conserved").when(other, "merged").when(one, "split").otherwise("complex")
    return pairs.withColumn("class", name)


def boundary_classes(pairs: DataFrame, target: DataFrame, query: DataFrame, res: int) -> DataFrame:
    """(chrom, class, pos, q_pos): boundary changes of region pairs of one-level sets, and the target boundaries that no pair has."""
    ends = pairs.select("chrom", F.explode(F.array(F.struct(F.col("t_start").alias("pos"), F.col("q_start").alias("q_pos")), F.struct(F.col("t_end").alias("pos"), F.col("q_end").alias("q_pos")))).alias("s"), F.struct("t_start", "t_end").alias("k"))
    # a later pair overwrites an earlier one
    kept = ends.select("chrom", "s.pos", "s.q_pos", "k").groupBy("chrom", "pos").agg(F.max_by("q_pos", "k").alias("q_pos"))
    levels = [boundary_levels(d, res).select("chrom", F.col("pos").alias(p), F.col("level").alias(name)) for d, p, name in ((target, "pos", "tl"), (query, "q_pos", "ql"))]
    # boundaries of the target without a partner among the query's stay with nulls
    found = levels[0].join(kept.join(levels[1], ["chrom", "q_pos"]), ["chrom", "pos"], "left")
    top, other = F.col("tl") == 0, F.col("ql") == 0
    name = F.when(F.col("ql").isNull(), F.when(top, "disappeared_tad").otherwise("disappeared_sub"))
    name = name.when(top & other, "conserved_tad").when(~top & ~other, "conserved_sub").when(top, "tad_to_sub").otherwise("sub_to_tad")
    return found.select("chrom", name.alias("class"), "pos", "q_pos")


def intersections(one: DataFrame, two: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """(chrom, start, end) shared by overlapping intervals of two sets."""
    both = overlapping(one.select("chrom", "start", "end"), two.select("chrom", "start", "end"), bucket=bucket)
    return both.select("chrom", intersect_start("start", "o_start").alias("start"), intersect_end("end", "o_end").alias("end"))


def gap_share(spans: DataFrame, gap_positions: DataFrame, res: int) -> DataFrame:
    """``spans`` (chrom, start, end) with the share of their bins among ``gap_positions`` (chrom, pos)."""
    bins = spans.select("chrom", "start", "end", F.explode(F.sequence("start", F.col("end") - 1, F.lit(res).cast("bigint"))).alias("pos"))
    flag = bins.join(gap_positions.select("chrom", "pos").distinct().withColumn("gap", F.lit(1.0)), ["chrom", "pos"], "left")
    return flag.groupBy("chrom", "start", "end").agg(F.avg(F.coalesce("gap", F.lit(0.0))).alias("gap_share"))


def fill_holes(domains: DataFrame, gap_positions: DataFrame, res: int, *, bucket: int = BUCKET) -> DataFrame:
    """Levels of ``domains`` and of every stretch between consecutive boundaries (three bins at least, less than a fifth of gap bins) that is none of them yet."""
    nxt = F.lead("pos").over(Window.partitionBy(*SET).orderBy("pos"))
    holes = boundary_levels(domains, res).select(*SET, F.col("pos").alias("start"), nxt.alias("end")).where(F.col("end") - F.col("start") >= 3 * res)
    good = gap_share(holes, gap_positions, res).where("gap_share < 0.2")
    holes = holes.join(good.select("chrom", "start", "end"), ["chrom", "start", "end"], "left_semi").select(*SET, "start", "end")
    return nested_levels(domains.select(*SET, "start", "end").unionByName(holes), bucket=bucket)


def swap_pairs(pairs: DataFrame) -> DataFrame:
    """Region pairs seen from the query's side."""
    turn: list[Column] = [F.col("q_" + c).alias("t_" + c) for c in ("start", "end")] + [F.col("t_" + c).alias("q_" + c) for c in ("start", "end")]
    return pairs.select("chrom", *turn, F.col("n_query").alias("n_target"), F.col("n_target").alias("n_query"))
