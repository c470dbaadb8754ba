"""Per-bin tracks of contact maps: directionality index, insulation, gap-free regions, domain noise, and what follows from them.

No dense matrix is made: every pixel is sent once to each bin it counts for, and sums over the zeros in between follow from counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.expressions import CHI2_3DF_05, chi2_transitions
from foldspark.operators.matrix import KEY

BIN = [*KEY, "bin"]


def default_window(res: int, n: int, span: int = 2_000_000) -> int:
    """Bins of the default window: ``span`` base pairs, at most half of the chromosome."""
    return min(span // res, n // 2)


def arms(pixels: DataFrame, widest: int) -> DataFrame:
    """(bin, d, up, down) for offsets 2 <= d < ``widest`` with a contact on either side: down = C(bin, bin + d), up = C(bin - d, bin)."""
    d = F.col("bin2") - F.col("bin1")
    zero = F.lit(0.0)
    both = F.array(
        F.struct(F.col("bin1").alias("bin"), zero.alias("up"), F.col("v").alias("down")),
        F.struct(F.col("bin2").alias("bin"), F.col("v").alias("up"), zero.alias("down")),
    )
    near = pixels.where((d > 1) & (d < widest)).select(*KEY, d.alias("d"), F.explode(both).alias("s")).select(*KEY, "s.bin", "d", "s.up", "s.down")
    return near.groupBy(*BIN, "d").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))


def _bias(within: Column, offsets: Column) -> Column:
    """The bias over offsets that satisfy ``within``, of which there are ``offsets``; 0 without variance or for less than two offsets.

    (mean up - mean down) / sqrt(SE up^2 + SE down^2), over the offsets with contacts on both sides if at least five have, else over all with their zeros.
    """
    joint = within & (F.col("up") != 0) & (F.col("down") != 0)
    n_joint = F.count_if(joint)

    def moments(name: str) -> tuple[Column, Column, Column]:
        use = lambda flag, x: F.coalesce(F.sum(F.when(flag, x)), F.lit(0.0))
        few = n_joint < 5
        s = F.when(few, use(within, F.col(name))).otherwise(use(joint, F.col(name)))
        q = F.when(few, use(within, F.col(name) * F.col(name))).otherwise(use(joint, F.col(name) * F.col(name)))
        n = F.when(few, offsets.cast("double")).otherwise(n_joint.cast("double"))
        return s, q, n

    (us, uq, n), (ds, dq, _) = moments("up"), moments("down")
    spread = ((uq - us * us / n) + (dq - ds * ds / n)) / (n * (n - 1))
    # differences of sums leave residues of some 1e-16 of the squares where there is no spread
    flat = spread <= 1e-13 * (uq + dq) / (n * n)
    return F.when((n <= 1) | flat, F.lit(0.0)).otherwise((us - ds) / n / F.sqrt(spread))


def directionality(pixels: DataFrame, windows: DataFrame, default: int, widest: int | None = None) -> DataFrame:
    """(bin, di) for every row of ``windows`` (bin, w): the bias over offsets 2 .. w - 1.

    A window of 0 is the default; a bias of 0 in a smaller window than the default is taken again in the default one. Not trimmed: see :func:`trim`.
    ``widest``: a bound of the windows; where it is not given it is looked up first.
    """
    w = F.when(F.col("w") == 0, F.lit(default)).otherwise(F.col("w"))
    # a window may exceed the default: arms as wide as any window
    asked = windows.select(*BIN, w.cast("bigint").alias("w"))
    reach = widest if widest is not None else windows.agg(F.max("w")).first()[0] or 0
    near = arms(pixels, max(default, int(reach)))
    joined = asked.join(near, BIN, "left")
    own, wide = F.col("d") < F.col("w"), F.col("d") < F.lit(default)
    size = F.greatest(F.first("w") - 2, F.lit(0))
    out = joined.groupBy(*BIN).agg(_bias(own, size).alias("a"), _bias(wide, F.lit(max(default - 2, 0))).alias("b"), F.first("w").alias("w"))
    di = F.when((F.col("a") == 0) & (F.col("w") < default), F.col("b")).otherwise(F.col("a"))
    return out.select(*BIN, di.alias("di"))


def trim(track: DataFrame, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """``di`` with negatives held at their ``low`` quantile and positives at their ``high`` one, by chromosome; an empty side is not trimmed."""
    at = track.groupBy(*KEY).agg(
        F.percentile(F.when(F.col("di") < 0, F.col("di")), F.lit(low)).alias("lo"), F.percentile(F.when(F.col("di") > 0, F.col("di")), F.lit(high)).alias("hi")
    )
    held = F.when(F.col("di") < F.col("lo"), F.col("lo")).when(F.col("di") > F.col("hi"), F.col("hi")).otherwise(F.col("di"))
    return track.join(at, KEY).select(*BIN, held.alias("di"))


def offset_grid(pixels: DataFrame, bins: DataFrame, default: int) -> DataFrame:
    """(bin, d, p) for all offsets 2 .. default - 1: p = up - down, 0 without contacts."""
    grid = bins.select(*BIN, F.explode(F.sequence(F.lit(2).cast("bigint"), F.lit(default - 1).cast("bigint"))).alias("d"))
    p = F.coalesce(F.col("up") - F.col("down"), F.lit(0.0))
    return grid.join(arms(pixels, default), [*BIN, "d"], "left").select(*BIN, "d", p.alias("p"))


def bias_fractions(grid: DataFrame) -> DataFrame:
    """(bin, d, down_fraction, up_fraction): shares of offsets so far with a downstream (p < 0) and an upstream (p > 0) bias."""
    so_far = Window.partitionBy(*BIN).orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda flag: F.avg(F.when(flag, 1.0).otherwise(0.0)).over(so_far)
    return grid.select(*BIN, "d", share(F.col("p") < 0).alias("down_fraction"), share(F.col("p") > 0).alias("up_fraction"))


def transition_test(grid: DataFrame) -> DataFrame:
    """(bin, chi2, reject): whether the sequence of (p > 0) over the offsets is not random, by its four transition counts."""
    x = F.when(F.col("p") > 0, 1).otherwise(0)
    before = F.lag(x).over(Window.partitionBy(*BIN).orderBy("d"))
    pairs = grid.select(*BIN, x.alias("x"), before.alias("y"))
    n = {f"n{a}{b}": F.count_if((F.col("y") == a) & (F.col("x") == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)}
    chi2 = chi2_transitions("n00", "n01", "n10", "n11")
    return pairs.groupBy(*BIN).agg(*n.values()).select(*BIN, chi2.alias("chi2"), F.coalesce(chi2 >= CHI2_3DF_05, F.lit(False)).alias("reject"))


def insulation(pixels: DataFrame, bins: DataFrame, w: int = 5) -> DataFrame:
    """(bin, score): mean of the w x w block above the bin, zeros included: bins [i - w, i) against (i, i + w]."""
    lo, hi = F.greatest(F.col("bin1") + 1, F.col("bin2") - w), F.least(F.col("bin1") + w, F.col("bin2") - 1)
    sent = pixels.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").select(*KEY, F.explode(F.sequence("lo", "hi")).alias("bin"), "v")
    sums = sent.groupBy(*BIN).agg(F.sum("v").alias("s"))
    return bins.select(*BIN).join(sums, BIN, "left").select(*BIN, (F.coalesce("s", F.lit(0.0)) / (w * w)).alias("score"))


def refine_boundaries(boundaries: DataFrame, scores: DataFrame) -> DataFrame:
    """``boundaries`` (bin, ...) with ``refined``: the first least insulation score among bin - 1, bin, bin + 1 that exist."""
    near = boundaries.withColumn("at", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    found = near.join(scores.select(*KEY, F.col("bin").alias("at"), "score"), [*KEY, "at"])
    return found.groupBy(*boundaries.columns).agg(F.min(F.struct("score", "at")).alias("m")).select(*boundaries.columns, F.col("m.at").alias("refined"))


def longest_gap(res: int) -> int:
    """Zeros in a row that a region may hold."""
    return max(100_000 // res, 5)


def gap_free_regions(track: DataFrame, res: int) -> DataFrame:
    """(start_bin, end_bin): stretches of non-zero ``di`` without longer gaps than allowed, longer than twice that.

    The end is exclusive where a chromosome has gaps; without a gap it is the last bin itself, which is then left out.
    """
    gap = longest_gap(res)
    by = Window.partitionBy(*KEY).orderBy("bin")
    full = track.where("di <> 0").select(*BIN, F.when(F.col("bin") - F.lag("bin").over(by) > gap + 1, 1).otherwise(0).alias("new"))
    island = full.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = island.groupBy(*KEY, "island").agg(F.min("bin").alias("start_bin"), F.max("bin").alias("last"))
    lone = F.count("*").over(Window.partitionBy(*KEY)) == 1
    ends = ends.withColumn("end_bin", F.when(lone, F.col("last")).otherwise(F.col("last") + 1))
    return ends.where(F.col("end_bin") - F.col("start_bin") > 2 * gap).select(*KEY, "start_bin", "end_bin")


def gap_bins(bins: DataFrame, regions: DataFrame) -> DataFrame:
    """Bins outside all regions."""
    inside = regions.select(*KEY, F.explode(F.sequence("start_bin", F.col("end_bin") - 1)).alias("bin"))
    return bins.select(*BIN).join(inside, BIN, "left_anti")


def region_values(track: DataFrame, regions: DataFrame) -> DataFrame:
    """Track rows inside regions, with the region's ends."""
    inside = regions.select("*", F.explode(F.sequence("start_bin", F.col("end_bin") - 1)).alias("bin"))
    return track.join(inside, BIN).select(*KEY, "start_bin", "end_bin", "bin", "di")


def training_sequences(track: DataFrame, regions: DataFrame, more_than: int = 20) -> DataFrame:
    """(start_bin, end_bin, seq): non-zero values of each region in order, where there are more than ``more_than``."""
    rows = region_values(track, regions).where("di <> 0")
    out = rows.groupBy(*KEY, "start_bin", "end_bin").agg(F.sort_array(F.collect_list(F.struct("bin", "di"))).alias("s"))
    return out.where(F.size("s") > more_than).select(*KEY, "start_bin", "end_bin", F.col("s.di").alias("seq"))


def domain_noise(pixels: DataFrame, domains: DataFrame, *, small_value: float = 0.0, min_bins: int = 5) -> DataFrame:
    """``domains`` (start_bin, end_bin, ...) with ``noise``: share of empty cells more than one off the diagonal; ``small_value`` for fewer than ``min_bins`` bins."""
    n = F.col("end_bin") - F.col("start_bin")
    rows = domains.select("*", F.explode(F.sequence("start_bin", F.col("end_bin") - 1)).alias("bin1"))
    hit = rows.join(pixels.where("bin2 - bin1 > 1").select(*KEY, "bin1", "bin2"), [*KEY, "bin1"]).where("bin2 < end_bin")
    full = hit.groupBy(*domains.columns).agg(F.count("*").alias("full"))
    share = 1 - 2 * F.coalesce("full", F.lit(0)) / ((n - 1) * (n - 2))
    small = (n < min_bins) | ((n - 1) * (n - 2) < 5)
    return domains.join(full, domains.columns, "left").select(*domains.columns, F.when(small, F.lit(float(small_value))).otherwise(share).alias("noise"))


def window_update(domains: DataFrame) -> DataFrame:
    """(bin, w) inside each domain: the distance to its farther end."""
    rows = domains.select(*KEY, "start_bin", "end_bin", F.explode(F.sequence("start_bin", F.col("end_bin") - 1)).alias("bin"))
    return rows.select(*BIN, F.greatest(F.col("bin") - F.col("start_bin") + 1, F.col("end_bin") - F.col("bin")).alias("w"))


def path_boundaries(path: DataFrame) -> DataFrame:
    """(start_bin, bound) from a state path (start_bin, bin, state): the region's start and end, and wherever state 3 is followed by 0."""
    by = Window.partitionBy(*KEY, "start_bin").orderBy("bin")
    turn = path.withColumn("before", F.lag("state").over(by)).where("before = 3 and state = 0").select(*KEY, "start_bin", F.col("bin").alias("bound"))
    ends = path.groupBy(*KEY, "start_bin").agg(F.min("bin").alias("a"), (F.max("bin") + 1).alias("b"))
    return turn.unionByName(ends.select(*KEY, "start_bin", F.explode(F.array("a", "b")).alias("bound"))).distinct()


def boundaries_to_domains(bounds: DataFrame) -> DataFrame:
    """(start_bin, domain_start, domain_end) between consecutive boundaries of a region."""
    nxt = F.lead("bound").over(Window.partitionBy(*KEY, "start_bin").orderBy("bound"))
    return bounds.select(*KEY, "start_bin", F.col("bound").alias("domain_start"), nxt.alias("domain_end")).where("domain_end is not null")
