"""Queries that write derived tables in the file formats of ``sources.io`` and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.operators import intervals
from foldspark.queries import query, views
from foldspark.queries.views import B, BINS, C1, DA, NEST, RES
from foldspark.sources import io
from foldspark.sources.kept import Kept


def _place(spark: SparkSession, name: str) -> str:
    """A folder of this run's own in the session's shared folder."""
    kept = Kept(spark, "files")
    kept.n = 1  # so that it goes with the session
    return f"{kept.root}/{name}"


_LEV = f"{NEST}, lev AS (SELECT x.chrom, x.s, x.e, count(*) - 1 AS level FROM nest x JOIN nest y ON x.chrom = y.chrom AND y.s <= x.s AND x.e <= y.e GROUP BY x.chrom, x.s, x.e)"


@query(f"WITH {_LEV} SELECT 'f' AS set_id, chrom[2:] AS chrom, s AS start, e AS \"end\", level FROM lev")
def hierarchical_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four columns, sorted; read back without their prefix."""
    path = _place(spark, "hier")
    io.write_hierarchical(intervals.nested_levels(views.nested(spark, sf_dir), bucket=100), path, single=False)
    return io.read_hierarchical(spark, path, "f", "c")


@query(f"WITH {DA} SELECT 'p' AS set_id, chrom, s AS start, e AS \"end\" FROM da WHERE s % 4 / 4.0 <= 0.5")
def plain_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of the domains that are not too noisy."""
    path = _place(spark, "plain")
    io.write_plain(views.segments(spark, sf_dir, 0).withColumn("noise", F.col("start") % 4 / 4), path, single=False)
    return io.read_plain(spark, path, "p", "")


@query(f"WITH {DA} SELECT chrom, s AS start, e AS \"end\" FROM da")
def tads_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any columns, a comment, a header, positions as floats."""
    path = _place(spark, "tads")
    rows = views.segments(spark, sf_dir, 0).select(F.concat_ws("  ", F.lit("x"), F.concat(F.lit("chr"), "chrom"), (F.col("start") + 0.25).cast("string"), F.col("end").cast("string")).alias("value"))
    head = spark.createDataFrame([("# comment",), ("id chr start end",), (" ",)], "value string")
    head.unionByName(rows).write.text(path)
    return io.read_tads(spark, path, "chr", (1, 2, 3))


@query("""SELECT chrom, start1, start1 + 10000 AS end1, start2, start2 + 10000 AS end2 FROM (
SELECT 'c' || l_suppkey % 5 AS chrom, 'c' || l_partkey % 5 AS chrom2, CAST(l_partkey * 10000 AS BIGINT) AS start1, CAST((l_partkey + l_linenumber) * 10000 AS BIGINT) AS start2 FROM lineitem) WHERE chrom = chrom2""")
def loops_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tab-separated columns; loops between chromosomes are left out."""
    path = _place(spark, "loops")
    rows = spark.sql(
        f"""SELECT concat('c', l_suppkey % 5) AS a, l_partkey * 10000L AS s1, l_partkey * 10000L + 10000 AS e1, concat('c', l_partkey % 5) AS b,
        (l_partkey + l_linenumber) * 10000L AS s2, (l_partkey + l_linenumber) * 10000L + 10000 AS e2 FROM parquet.`{sf_dir}/lineitem.parquet`"""
    )
    rows.write.csv(path, sep="\t")
    return io.read_loops(spark, path)


@query("SELECT CAST((n_regionkey + 1) * 10000 AS BIGINT) AS res, n_name AS label, 'store://maps/' || n_nationkey || '::/x' AS uri FROM nation")
def dataset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of one resolution, each with its datasets; a uri may hold colons."""
    path = _place(spark, "datasets")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    line = F.concat("n_name", F.lit(":store://maps/"), F.col("n_nationkey").cast("string"), F.lit("::/x"))
    block = F.concat(F.lit("res:"), ((F.col("n_regionkey") + 1) * 10000).cast("string"), F.lit("\n"), F.array_join(F.collect_list(line), "\n"))
    rows.groupBy("n_regionkey").agg(block.alias("value")).select("value").coalesce(1).write.text(path)
    return io.read_datasets(spark, path)


@query(f"""WITH {C1}, {B} SELECT chrom, s AS start, e AS "end", w AS kr FROM bins WHERE chrom = 'A' AND e > {10 * RES} AND s < {30 * RES}""")
def bin_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the bins of a region, from a map's folder; any column may be there."""
    return _map(spark, sf_dir).bin_columns("chrom", "start", "end", "kr", chrom="A", start=10 * RES, end=30 * RES)


def _map(spark: SparkSession, sf_dir: str) -> io.ContactMap:
    path = _place(spark, "map")
    bins = views.bins(spark, sf_dir).withColumnRenamed("weight", "kr")
    io.write_map(io.ContactMap("d", bins.groupBy("chrom").agg(F.max("end").alias("length")), bins, views.raw(spark, sf_dir)), path)
    return io.open_map(spark, path, "d")


@query(f"""WITH {C1}, {B}, u AS (SELECT c1.chrom, bin1, bin2, count * x.w * y.w AS v FROM c1 JOIN bins x ON x.chrom = c1.chrom AND x.bin = bin1 JOIN bins y ON y.chrom = c1.chrom AND y.bin = bin2
  WHERE c1.chrom = 'N' AND bin1 >= 20 AND bin2 < 60), s AS (SELECT chrom, bin1, bin2, v FROM u UNION ALL SELECT chrom, bin2, bin1, v FROM u WHERE bin1 <> bin2)
SELECT 'd' AS dataset, chrom, bin1, bin2, round(v, 6) AS v FROM s""")
def map_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's balanced contacts, from a map's folder, by a balancing column of another name."""
    return _map(spark, sf_dir).fetch("N", 20 * RES, 60 * RES, "kr").withColumn("v", F.round("v", 6))


@query(f"""WITH {B} SELECT 'chr' || chrom AS chrom, s AS start, e AS "end", printf('%.4g', CAST(bin * 12.345678 AS DOUBLE)) AS value FROM bins WHERE chrom = 'R' AND e > {50 * RES} AND s < {BINS * RES}""")
def index_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index column of a region, written as text and read back."""
    path = _place(spark, "index")
    track = views.bins(spark, sf_dir).withColumn("di", F.col("bin") * 12.345678).withColumn("chrom", F.col("chrom"))
    rows = io.index_rows(track, "di", "R", 50 * RES, BINS * RES).withColumn("chrom", F.concat(F.lit("chr"), "chrom"))
    io.write_bedgraph(rows, path, single=False)
    return spark.read.csv(path, sep="\t", schema="chrom string, start bigint, end bigint, value string")


@query('SELECT c_mktsegment AS "ChromID", CAST(c_custkey * 10 AS BIGINT) AS "Start", CAST(c_custkey * 10 + 5 AS BIGINT) AS "End", CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_custkey / 4.0 END AS "AP", c_nationkey / 8.0 AS "Gap-Ratio" FROM customer')
def feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with their header, written as text and read back."""
    path = _place(spark, "features")
    rows = spark.sql(
        f"""SELECT c_mktsegment AS chrom, c_custkey * 10L AS start, c_custkey * 10L + 5 AS end, CASE WHEN c_custkey % 3 = 0 THEN -1.0D ELSE c_custkey / 4.0D END AS ap, c_nationkey / 8.0D AS gap_ratio
        FROM parquet.`{sf_dir}/customer.parquet`"""
    )
    io.write_features(rows, path, single=False)
    return spark.read.csv(path, sep="\t", header=True, schema="ChromID string, Start bigint, End bigint, AP double, `Gap-Ratio` double")
