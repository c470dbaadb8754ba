"""Contact maps and interval sets derived from the driver's tables, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 200
RES = 40_000
DEFAULT = 50

_X = "(l_partkey * 200) {div} (SELECT max(l_partkey) + 1 FROM {t})"
_Y = _X + " + CAST(l_quantity AS BIGINT) - 1"

# three chromosomes for every hundred suppliers: a map grows with the tables
_CHROM = "concat(l_returnflag, CASE WHEN l_suppkey < 100 THEN '' ELSE CAST(l_suppkey {div} 100 AS STRING) END)"

_CONTACTS = f"""SELECT {_CHROM} AS chrom, CAST({_X} AS BIGINT) AS bin1, CAST({_Y} AS BIGINT) AS bin2, CAST(count(*) AS DOUBLE) AS count
FROM {{t}} WHERE {_Y} < 200{{where}} GROUP BY 1, 2, 3"""

_PLANTED = """SELECT chrom, bin1, bin2, count * (CASE WHEN bin1 {div} 20 = bin2 {div} 20 THEN 4 ELSE 1 END) * (CASE WHEN bin1 {div} 10 = bin2 {div} 10 THEN 2 ELSE 1 END) AS v
FROM ({c1})"""


def _c1(t: str, div: str, rep: int | None) -> str:
    return _CONTACTS.format(t=t, div=div, where="" if rep is None else f" AND l_orderkey % 2 = {rep}")


def raw(spark: SparkSession, sf_dir: str, rep: int | None = None) -> DataFrame:
    """Raw contacts (count) as dataset ``d``, or ``rep0`` / ``rep1``."""
    df = spark.sql(_c1(f"parquet.`{sf_dir}/lineitem.parquet`", "div", rep))
    return df.select(F.lit("d" if rep is None else f"rep{rep}").alias("dataset"), "*")


def pixels(spark: SparkSession, sf_dir: str, rep: int | None = None) -> DataFrame:
    """Contacts with planted blocks of 20 bins and nested ones of 10."""
    df = spark.sql(_PLANTED.format(c1=_c1(f"parquet.`{sf_dir}/lineitem.parquet`", "div", rep), div="div"))
    return df.select(F.lit("d" if rep is None else f"rep{rep}").alias("dataset"), "*")


def flat_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw contacts as values."""
    return raw(spark, sf_dir).withColumnRenamed("count", "v")


def bins(spark: SparkSession, sf_dir: str, name: str = "d") -> DataFrame:
    chroms = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.expr(_CHROM.format(div="div")).alias("chrom")).distinct()
    b = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint"))).alias("bin")
    rows = chroms.select(F.lit(name).alias("dataset"), "chrom", b)
    return rows.select("*", (F.col("bin") * RES).alias("start"), ((F.col("bin") + 1) * RES).alias("end"), (1 / (1 + F.col("bin") % 4)).alias("weight"))


def sizes(spark: SparkSession, sf_dir: str, name: str = "d") -> DataFrame:
    return bins(spark, sf_dir, name).groupBy("dataset", "chrom").agg(F.count("*").alias("n"))


#: Set 0 and set 1 share the customers by nation; set 2 has them all.
_SETS = ("c_nationkey < 13", "c_nationkey >= 13", "true")


def segments(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Adjacent single-level domains of set ``k``, resolution 1."""
    return spark.sql(
        f"""SELECT '{k}' AS set_id, chrom, start, end, 0L AS level FROM (
        SELECT c_mktsegment AS chrom, CAST(c_custkey AS BIGINT) AS start, CAST(lead(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS BIGINT) AS end
        FROM parquet.`{sf_dir}/customer.parquet` WHERE {_SETS[k]}) WHERE end IS NOT NULL"""
    )


def hierarchy(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """A hierarchy of resolution 1: the segments of set ``k``, and blocks of them (by 120 positions) as outer domains."""
    from foldspark.operators.intervals import nested_levels

    d = segments(spark, sf_dir, k).select("set_id", "chrom", "start", "end")
    wide = d.withColumn("k", F.floor(F.col("start") / 120)).groupBy("set_id", "chrom", "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")
    return nested_levels(d.unionByName(wide), bucket=100)


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested intervals of every customer: days from the first to the last order, the same by order status, and from each order to the next."""
    days = "CAST(datediff(o_orderdate, DATE '1990-01-01') AS BIGINT)"
    return spark.sql(
        f"""WITH o AS (SELECT concat('c', o_custkey) AS chrom, o_orderstatus AS st, {days} AS d, o_orderkey AS k FROM parquet.`{sf_dir}/orders.parquet`)
        SELECT 'n' AS set_id, chrom, start, end FROM (
        SELECT chrom, min(d) AS start, max(d) AS end FROM o GROUP BY chrom UNION ALL SELECT chrom, min(d), max(d) FROM o GROUP BY chrom, st
        UNION ALL SELECT chrom, d, lead(d) OVER (PARTITION BY chrom ORDER BY d, k) FROM o) WHERE end > start"""
    )


def planted_domains(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    """The planted blocks of ``size`` bins (start_bin, end_bin)."""
    rows = bins(spark, sf_dir).where(F.col("bin") % size == 0)
    return rows.select("dataset", "chrom", F.col("bin").alias("start_bin"), (F.col("bin") + size).alias("end_bin"))


# DuckDB forms: CTEs c1, c2 (dataset d), bins, dA, dB, nest
C1 = f"c1 AS ({_c1('lineitem', '//', None)})"
C2 = f"{C1}, c2 AS ({_PLANTED.format(c1='SELECT * FROM c1', div='//')})"
B = f"bins AS (SELECT chrom, bin, bin * {RES} AS s, (bin + 1) * {RES} AS e, 1.0 / (1 + bin % 4) AS w FROM (SELECT DISTINCT {_CHROM.format(div='//')} AS chrom FROM lineitem), (SELECT unnest(range(0, {BINS})) AS bin))"


def _segments(k: int) -> str:
    return f"""SELECT chrom, s, e, 0 AS level FROM (SELECT c_mktsegment AS chrom, CAST(c_custkey AS BIGINT) AS s,
      CAST(lead(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS BIGINT) AS e FROM customer WHERE {_SETS[k]}) WHERE e IS NOT NULL"""


DA, DB = f"da AS ({_segments(0)})", f"db AS ({_segments(1)})"
NEST = """od AS (SELECT 'c' || o_custkey AS chrom, o_orderstatus AS st, CAST(date_diff('day', DATE '1990-01-01', o_orderdate) AS BIGINT) AS d, o_orderkey AS k FROM orders),
nest AS (SELECT DISTINCT chrom, s, e FROM (SELECT chrom, min(d) AS s, max(d) AS e FROM od GROUP BY 1 UNION ALL SELECT chrom, min(d), max(d) FROM od GROUP BY chrom, st
  UNION ALL SELECT chrom, d, lead(d) OVER (PARTITION BY chrom ORDER BY d, k) FROM od) WHERE e > s)"""
