"""Readers and writers: contact maps as Parquet folders, interval files, loops, dataset lists, and the result files.

A map is a folder with ``chroms``, ``bins`` and ``pixels`` tables, the last two partitioned by chromosome, so that reading one chromosome touches its files only.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foldspark.functions.expressions import force_prefix, is_number, strip_prefix
from foldspark.operators import matrix
from foldspark.sources import schema


@dataclass
class ContactMap:
    """One dataset at one resolution."""

    name: str
    chroms: DataFrame
    bins: DataFrame
    raw: DataFrame

    @property
    def res(self) -> int:
        row = self.bins.agg(F.max(F.col("end") - F.col("start"))).first()
        return int(row[0])

    @property
    def chromnames(self) -> list[str]:
        return [r[0] for r in self.chroms.orderBy("chrom").select("chrom").collect()]

    def sizes(self) -> DataFrame:
        """(dataset, chrom, n)."""
        return self.bins.groupBy("dataset", "chrom").agg(F.count("*").alias("n"))

    def pixels(self, balance: str | None = "weight", chrom: str | None = None) -> DataFrame:
        """Balanced (or, with None or RAW, raw) pixels, of one chromosome if named."""
        raw, bins = self.raw, self.bins
        if chrom is not None:
            raw, bins = raw.where(F.col("chrom") == chrom), bins.where(F.col("chrom") == chrom)
        return matrix.upper(matrix.balance(raw, bins, None if balance in (None, "RAW") else balance))

    def fetch(self, chrom: str, start: int, end: int, balance: str | None = "weight") -> DataFrame:
        """Pixels of a region, its end clipped to the chromosome, both triangles."""
        part = matrix.clipped_region(self.pixels(balance, chrom), self.chroms, self.res, start, end)
        return matrix.symmetric(part)

    def bin_columns(self, *columns: str, chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """Columns of the bins, of a chromosome or of the bins that overlap a region."""
        out = self.bins
        if chrom is not None:
            out = out.where(F.col("chrom") == chrom)
        if start is not None and end is not None:
            out = out.where((F.col("end") > start) & (F.col("start") < end))
        return out.select(*columns)


def write_map(cmap: ContactMap, path: str) -> None:
    cmap.chroms.write.mode("overwrite").parquet(f"{path}/chroms")
    cmap.bins.write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/bins")
    cmap.raw.repartition("chrom").sortWithinPartitions("chrom", "bin1").write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/pixels")


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """The bins table of a map with all its columns, whatever their names; chromosome names stay text."""
    found = spark.read.parquet(f"{path}/bins").schema
    found = StructType([StructField(f.name, StringType() if f.name == "chrom" else f.dataType) for f in found])
    return spark.read.schema(found).parquet(f"{path}/bins")


def open_map(spark: SparkSession, path: str, name: str | None = None) -> ContactMap:
    name = name or path.rstrip("/").rsplit("/", 1)[-1]
    named = lambda df: df.withColumn("dataset", F.lit(name))
    bins = named(read_bins(spark, path).drop("dataset"))
    raw = named(spark.read.schema(schema.RAW).parquet(f"{path}/pixels").drop("dataset"))
    return ContactMap(name, spark.read.schema(schema.CHROMS).parquet(f"{path}/chroms"), bins, raw)


def parse_datasets(text: str) -> dict[int, dict[str, str]]:
    """``res:INT`` lines, each followed by ``label:uri`` lines (a uri may hold colons) -> {res: {label: uri}}."""
    out: dict[int, dict[str, str]] = {}
    res = None
    for line in map(str.strip, text.splitlines()):
        if not line:
            continue
        label, _, rest = line.partition(":")
        if label.strip() == "res":
            res = int(rest)
            out[res] = {}
        elif res is None:
            raise ValueError(f"a dataset before any resolution: {line}")
        else:
            out[res][label.strip()] = rest.strip()
    return out


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """(res, label, uri) of a dataset list file, read whole on the driver: it names files, a line each."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame([(r, k, u) for r, d in parse_datasets(text).items() for k, u in d.items()], schema.DATASETS)


def _words(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(F.split(F.trim("value"), r"\s+").alias("w"))


def _at(i: int) -> Column:
    return F.get("w", i)


def read_hierarchical(spark: SparkSession, path: str, set_id: str = "", prefix: str = "") -> DataFrame:
    """Domains of a file of four columns (chrom, start, end, level); those that do not end after their start are dropped."""
    rows = _words(spark, path).select(
        F.lit(set_id).alias("set_id"), (strip_prefix(_at(0), prefix) if prefix else _at(0)).alias("chrom"), _at(1).cast("bigint").alias("start"), _at(2).cast("bigint").alias("end"), _at(3).cast("bigint").alias("level")
    )
    return rows.where("end > start")


def read_plain(spark: SparkSession, path: str, set_id: str = "", prefix: str = "chr") -> DataFrame:
    """(set_id, chrom, start, end) of a file of three columns."""
    rows = _words(spark, path).select(
        F.lit(set_id).alias("set_id"), (strip_prefix(_at(0), prefix) if prefix else _at(0)).alias("chrom"), _at(1).cast("bigint").alias("start"), _at(2).cast("bigint").alias("end")
    )
    return rows.where("end > start")


def read_tads(spark: SparkSession, path: str, prefix: str | None = None, columns: tuple[int, int, int] = (0, 1, 2)) -> DataFrame:
    """(chrom, start, end) at any columns; comment lines and rows without numeric ends are skipped; positions may be written as floats, and are truncated."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')").select(F.split(F.trim("value"), r"\s+").alias("w"))
    a, s, e = (F.get("w", k) for k in columns)
    rows = rows.where(is_number(s) & is_number(e))
    chrom = F.expr(f"substring(w[{columns[0]}], {len(prefix) + 1})") if prefix else a
    return rows.select(chrom.alias("chrom"), s.cast("double").cast("bigint").alias("start"), e.cast("double").cast("bigint").alias("end"))


def read_loops(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start1, end1, start2, end2) of the loops within one chromosome."""
    rows = spark.read.csv(path, sep="\t", schema=schema.LOOPS)
    return rows.where("chrom1 = chrom2").select(F.col("chrom1").alias("chrom"), "start1", "end1", "start2", "end2")


@F.pandas_udf(StringType())
def four_digits(x: pd.Series) -> pd.Series:
    """``%.4g``."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.4g}")


def _sorted_text(rows: DataFrame, path: str, by: list[str], single: bool, header: bool = False) -> None:
    """Tab-separated rows in order: one file, or (not ``single``) one for each range of the order, named in order."""
    rows = rows.orderBy(*by)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, sep="\t", header=header)


def write_hierarchical(domains: DataFrame, path: str, single: bool = True) -> None:
    """Four tab-separated columns, sorted."""
    _sorted_text(domains.select("chrom", "start", "end", "level"), path, ["chrom", "start", "end", "level"], single)


def write_plain(domains: DataFrame, path: str, most_noise: float = 0.5, single: bool = True) -> None:
    """Three columns of the domains that are not too noisy."""
    rows = domains.where(F.col("noise") <= most_noise) if "noise" in domains.columns else domains
    _sorted_text(rows.select("chrom", "start", "end"), path, ["chrom", "start", "end"], single)


def with_index_column(bins: DataFrame, track: DataFrame, name: str = "di") -> DataFrame:
    """``bins`` with the index of ``track`` (dataset, chrom, bin, di) as column ``name``; bins of other chromosomes get 0."""
    out = bins.drop(name).join(track.select("dataset", "chrom", "bin", F.col("di").alias(name)), ["dataset", "chrom", "bin"], "left")
    return out.withColumn(name, F.coalesce(name, F.lit(0.0)))


def put_index(spark: SparkSession, path: str, track: DataFrame, name: str = "di") -> None:
    """Write the index of ``track`` into a map's own bins table as column ``name``. The new table is written whole beside the old one, which then makes room for it."""
    new, old = f"{path}/_bins-new", f"{path}/_bins-old"
    bins = read_bins(spark, path)
    had = "dataset" in bins.columns
    label = track.select("dataset").first()
    named = bins.drop("dataset").withColumn("dataset", F.lit(label[0] if label else ""))
    done = with_index_column(named, track, name)
    (done if had else done.drop("dataset")).write.mode("overwrite").option("compression", "gzip").partitionBy("chrom").parquet(new)
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(hadoop.Path(old), True)
    for a, b in ((f"{path}/bins", old), (new, f"{path}/bins")):
        if not store.rename(hadoop.Path(a), hadoop.Path(b)):
            raise OSError(f"{a} could not become {b}")
    store.delete(hadoop.Path(old), True)
    spark.catalog.refreshByPath(f"{path}/bins")


def bedgraph(bins: DataFrame, track: DataFrame, chroms: DataFrame, name: str = "di") -> DataFrame:
    """(chrom with prefix, start, end clipped to the chromosome, di as text)."""
    rows = bins.select("dataset", "chrom", "bin", "start", "end").join(track.select("dataset", "chrom", "bin", F.col(name).alias("di")), ["dataset", "chrom", "bin"]).join(chroms, "chrom")
    return rows.select(force_prefix("chrom").alias("chrom"), "start", F.least("end", "length").alias("end"), four_digits("di").alias("di"))


def write_bedgraph(rows: DataFrame, path: str, single: bool = True) -> None:
    _sorted_text(rows, path, ["chrom", "start"], single)


def index_rows(bins: DataFrame, column: str = "di", chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Exported index rows (chrom, start, end, value as text), of a chromosome or of a region if both ends are given."""
    rows = bins if chrom is None else bins.where(F.col("chrom") == chrom)
    if start is not None and end is not None:
        rows = rows.where((F.col("end") > start) & (F.col("start") < end))
    return rows.select("chrom", "start", "end", four_digits(F.col(column)).alias("value"))


def write_features(features: DataFrame, path: str, single: bool = True) -> None:
    """Header ChromID Start End AP Gap-Ratio; rejected domains have AP -1."""
    rows = features.select(F.col("chrom").alias("ChromID"), F.col("start").alias("Start"), F.col("end").alias("End"), F.col("ap").alias("AP"), F.col("gap_ratio").alias("Gap-Ratio"))
    _sorted_text(rows, path, ["ChromID", "Start", "End"], single, header=True)
