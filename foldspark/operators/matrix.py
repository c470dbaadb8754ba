"""Contact matrices as pixel tables: columns dataset, chrom, bin1, bin2, v with bin1 <= bin2 and v <> 0, bins relative to the chromosome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["dataset", "chrom"]


def balance(raw: DataFrame, bins: DataFrame, weight: str | None = "weight") -> DataFrame:
    """v = count * weight[bin1] * weight[bin2] of raw pixels (count); ``weight`` None takes raw counts. Masked bins (null or NaN) give no pixel."""
    if weight is None:
        return finite(raw.select(*KEY, "bin1", "bin2", F.col("count").cast("double").alias("v")))
    w = bins.select(*KEY, F.col("bin"), F.col(weight).cast("double").alias("w")).where(~F.isnan("w"))
    one, two = (w.select(*KEY, F.col("bin").alias(f"bin{k}"), F.col("w").alias(f"w{k}")) for k in (1, 2))
    out = raw.join(one, [*KEY, "bin1"]).join(two, [*KEY, "bin2"])
    return finite(out.select(*KEY, "bin1", "bin2", (F.col("count") * F.col("w1") * F.col("w2")).alias("v")))


def finite(pixels: DataFrame) -> DataFrame:
    """NaN and null count as zero, and zeros are no pixels."""
    return pixels.where("v is not null and not isnan(v) and v <> 0")


def upper(pixels: DataFrame) -> DataFrame:
    return pixels.where("bin1 <= bin2")


def exclude_chroms(df: DataFrame, names: Sequence[str] = ("chrY", "chrM")) -> DataFrame:
    return df.where(~F.col("chrom").isin(*names)) if names else df


def exclude_small(df: DataFrame, bins: DataFrame, res: int, least: int = 1_000_000) -> DataFrame:
    """Without chromosomes that have fewer than ``least`` base pairs in any dataset."""
    small = bins.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") * res < least).select("chrom").distinct()
    return df.join(small, "chrom", "left_anti")


def region(pixels: DataFrame, start: int, end: int) -> DataFrame:
    """Pixels with both bins in [start, end)."""
    return pixels.where((F.col("bin1") >= start) & (F.col("bin1") < end) & (F.col("bin2") >= start) & (F.col("bin2") < end))


def clipped_region(pixels: DataFrame, chroms: DataFrame, res: int, start: int, end: int) -> DataFrame:
    """Pixels of the base-pair interval [start, end), the end clipped to the chromosome's length."""
    last = F.ceil(F.least(F.lit(end), F.col("length")) / res)
    out = pixels.where((F.col("bin1") >= start // res) & (F.col("bin2") >= start // res)).join(chroms.select("chrom", "length"), "chrom")
    return out.where((F.col("bin1") < last) & (F.col("bin2") < last)).select(*pixels.columns)


def symmetric(pixels: DataFrame) -> DataFrame:
    """Both triangles: (bin1, bin2) and (bin2, bin1)."""
    sides = F.when(F.col("bin1") == F.col("bin2"), F.array(F.struct("bin1", "bin2"))).otherwise(
        F.array(F.struct("bin1", "bin2"), F.struct(F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2")))
    )
    return pixels.select(*KEY, F.explode(sides).alias("s"), "v").select(*KEY, "s.bin1", "s.bin2", "v")


def from_records(records: DataFrame, start: int, end: int) -> DataFrame:
    """Interaction records (bin1, bin2, v; either order) of [start, end) as pixels relative to start; duplicates are summed."""
    a, b = F.least("bin1", "bin2"), F.greatest("bin1", "bin2")
    inside = records.where((a >= start) & (b < end))
    return inside.groupBy(*KEY, (a - start).alias("bin1"), (b - start).alias("bin2")).agg(F.sum("v").alias("v"))


def distance_decay(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean value of every diagonal d from 0 to n - 1, zeros included; ``sizes``: (dataset, chrom, n)."""
    sums = pixels.groupBy(*KEY, (F.col("bin2") - F.col("bin1")).alias("d")).agg(F.sum("v").alias("s"))
    grid = sizes.select(*KEY, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("d"))
    return grid.join(sums, [*KEY, "d"], "left").select(*KEY, "d", (F.coalesce("s", F.lit(0.0)) / (F.col("n") - F.col("d"))).alias("mean_v"))


def rescale_factor(pixels: DataFrame) -> DataFrame:
    """What values are divided by: the least non-zero where the median of the (symmetric) non-zeros is below 1, else 1."""
    weight = F.when(F.col("bin1") == F.col("bin2"), 1).otherwise(2)
    got = pixels.where("v <> 0").groupBy(*KEY).agg(F.percentile("v", F.lit(0.5), weight).alias("median_v"), F.min("v").alias("least_v"))
    return got.select(*KEY, "median_v", F.when(F.col("median_v") < 1, F.col("least_v")).otherwise(F.lit(1.0)).alias("factor"))


def rescale(pixels: DataFrame) -> DataFrame:
    return pixels.join(rescale_factor(pixels), KEY).withColumn("v", F.col("v") / F.col("factor")).select(*pixels.columns)


def touched_bins(pixels: DataFrame) -> DataFrame:
    """Bins with a non-zero value in their row or column."""
    return pixels.where("v <> 0").select(*KEY, F.explode(F.array("bin1", "bin2")).alias("bin")).distinct()


def gap_ratio(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """1 - touched / all bins."""
    full = touched_bins(pixels).groupBy(*KEY).agg(F.count("*").alias("full"))
    return sizes.join(full, KEY, "left").select(*KEY, (1 - F.coalesce("full", F.lit(0)) / F.col("n")).alias("gap_ratio"))


def gap_free_index(pixels: DataFrame) -> DataFrame:
    """(bin, idx): bins with values numbered from 0 without the empty ones."""
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy("bin")) - 1
    return touched_bins(pixels).select(*KEY, "bin", at.cast("bigint").alias("idx"))


def drop_gaps(pixels: DataFrame) -> DataFrame:
    """Pixels by gap-free index."""
    return _renumber(pixels, gap_free_index(pixels).select(*KEY, F.col("bin").alias("from"), F.col("idx").alias("to")))


def restore_gaps(pixels: DataFrame, index: DataFrame) -> DataFrame:
    """Pixels by gap-free index back at their bins; ``index`` as of :func:`gap_free_index`."""
    return _renumber(pixels, index.select(*KEY, F.col("idx").alias("from"), F.col("bin").alias("to")))


def _renumber(pixels: DataFrame, index: DataFrame) -> DataFrame:
    for c in ("bin1", "bin2"):
        pixels = pixels.join(index.select(*KEY, F.col("from").alias(c), F.col("to").alias("_to")), [*KEY, c]).drop(c).withColumnRenamed("_to", c)
    return pixels.select(*KEY, "bin1", "bin2", "v")
