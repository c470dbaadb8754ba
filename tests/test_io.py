"""Readers, writers, the command line."""

import pytest
from pyspark.sql import functions as F

from foldspark.plans import cli, pipeline
from foldspark.queries import views
from foldspark.sources import io


def put(path, text):
    path.write_text(text)
    return str(path)


def test_parse_datasets():
    text = "res:10000\n\n  rep1:s3://bucket/a.cool::/x\nrep2:b\nres:40000\nrep1:c\n"
    assert io.parse_datasets(text) == {10000: {"rep1": "s3://bucket/a.cool::/x", "rep2": "b"}, 40000: {"rep1": "c"}}
    with pytest.raises(ValueError):
        io.parse_datasets("rep1:a")


def test_interval_files(spark, tmp_path):
    h = io.read_hierarchical(spark, put(tmp_path / "h", "chr1 0 100 0\nchr1\t10   5 1\n\n chr2 5 10 1\n"), "s", "chr")
    assert sorted(map(tuple, h.collect())) == [("s", "1", 0, 100, 0), ("s", "2", 5, 10, 1)]
    p = io.read_plain(spark, put(tmp_path / "p", "chr1 0 100\nhrc1 2 9\n"))
    assert sorted(r["chrom"] for r in p.collect()) == ["1", "hrc1"]  # a prefix, not a set of characters
    t = io.read_tads(spark, put(tmp_path / "t", "# c\nid chr start end\nx chr1 10.7 20\ny chr2 a 3\n"), "chr", (1, 2, 3))
    assert [tuple(r) for r in t.collect()] == [("1", 10, 20)]
    loops = io.read_loops(spark, put(tmp_path / "l", "1\t10\t20\t1\t50\t60\n1\t10\t20\t2\t50\t60\n"))
    assert [tuple(r) for r in loops.collect()] == [("1", 10, 20, 50, 60)]


def make_map(spark, sf, path, name, rep=None):
    raw = views.raw(spark, sf, rep)
    planted = views.pixels(spark, sf, rep).select("dataset", "chrom", "bin1", "bin2", F.col("v").alias("count"))
    bins = views.bins(spark, sf).withColumn("di", F.lit(None).cast("double"))
    chroms = bins.groupBy("chrom").agg((F.max("end") - 500).alias("length"))
    io.write_map(io.ContactMap(name, chroms, bins, planted), path)
    return raw


def test_map_round_trip(spark, sf, tmp_path):
    make_map(spark, sf, str(tmp_path / "m"), "m")
    m = io.open_map(spark, str(tmp_path / "m"))
    assert m.res == views.RES and m.chromnames == ["A", "N", "R"] and m.pixels("RAW").count() == views.pixels(spark, sf).count()
    one = m.fetch("A", 0, 10**9, None)
    assert {r[0] for r in one.select("chrom").distinct().collect()} == {"A"} and one.agg(F.max("bin2")).first()[0] <= 199
    assert m.bin_columns("start", chrom="A", start=50_000, end=90_000).count() == 2
    plan = m.pixels("RAW", "A")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan


def test_four_digits(spark):
    rows = spark.createDataFrame([(1234567.0,), (0.00001234,), (None,)], "x double").select(io.four_digits("x").alias("y")).collect()
    assert [r[0] for r in rows] == ["1.235e+06", "1.234e-05", None]


def test_tools(spark, sf, tmp_path):
    sf = sf.replace("sf0.001", "sf0.01")
    path = str(tmp_path / "m")
    make_map(spark, sf, path, "m")
    cli.main(["domains", "--uri", path, "-O", f"{tmp_path}/d", "-D", f"{tmp_path}/di", "-W", "RAW", "--removeCache"])
    domains = io.read_plain(spark, f"{tmp_path}/d")
    assert domains.count() > 3 and spark.read.text(f"{tmp_path}/di").count() == 600
    cli.main(["features", "-p", path, "-t", f"{tmp_path}/d", "-O", f"{tmp_path}/f", "--balance", "RAW"])
    got = spark.read.csv(f"{tmp_path}/f", sep="\t", header=True)
    assert got.columns == ["ChromID", "Start", "End", "AP", "Gap-Ratio"] and got.count() == domains.count()
    put(tmp_path / "meta", f"res:{views.RES}\nrep1:{path}\n")
    cli.main(["hierarchy", "-d", f"{tmp_path}/meta", "-O", f"{tmp_path}/h", "-W", "RAW"])
    assert io.read_hierarchical(spark, f"{tmp_path}/h").count() > 0
    # the index went into the map itself, beside its other columns
    cli.main(["export-index", "-p", path, "-C", "A", "-D", "DIs", "-S", "0", "-E", "100000", "-O", f"{tmp_path}/o"])
    assert spark.read.text(f"{tmp_path}/o").count() == 3
    kept = io.read_bins(spark, path)
    assert {"DIs", "weight", "bin"} <= set(kept.columns) and kept.where("DIs <> 0").count() > 100 and kept.count() == 600
    cli.main(["plot-tables", "-p", path, "-T", f"{tmp_path}/h", "-D", "DIs", "-C", "A", "-W", "RAW", "-O", f"{tmp_path}/v"])
    assert spark.read.parquet(f"{tmp_path}/v/cells").count() > 0
    lo, hi = 20 * views.RES, 60 * views.RES
    cli.main(["plot-tables", "-p", path, "-T", f"{tmp_path}/h", "-D", "DIs", "-C", "A", "-W", "RAW", "-O", f"{tmp_path}/w", "-S", str(lo), "-E", str(hi), "--arrowhead", "--vmin", "-1", "--vmax", "1"])
    cells = spark.read.parquet(f"{tmp_path}/w/cells")
    assert cells.count() > 0 and cells.agg(F.min("bin1"), F.max("bin2"), F.max(F.abs("v"))).first()[0] >= 20 and cells.where("bin2 >= 60 or abs(v) > 1").count() == 0
    assert [tuple(r)[2:] for r in spark.read.parquet(f"{tmp_path}/w/limit").collect()] == [(-1.0, 1.0)] and spark.read.parquet(f"{tmp_path}/w/track").count() == 40


def test_other_weight_column(spark, sf, tmp_path):
    """Any bin column balances, and further columns of the bins stay."""
    path = str(tmp_path / "m")
    raw, bins = views.raw(spark, sf), views.bins(spark, sf).withColumnRenamed("weight", "KR").withColumn("gc", F.lit(0.4)).withColumn("chrom", F.concat(F.lit("0"), F.ascii("chrom").cast("string")))
    raw = raw.withColumn("chrom", F.concat(F.lit("0"), F.ascii("chrom").cast("string")))
    io.write_map(io.ContactMap("m", bins.groupBy("chrom").agg(F.max("end").alias("length")), bins, raw), path)
    m = io.open_map(spark, path)
    assert {"KR", "gc"} <= set(m.bins.columns) and all(c.startswith("0") for c in m.chromnames)
    want = views.raw(spark, sf).join(views.bins(spark, sf).select("chrom", F.col("bin").alias("bin1"), F.col("weight").alias("w1")), ["chrom", "bin1"])
    want = want.join(views.bins(spark, sf).select("chrom", F.col("bin").alias("bin2"), F.col("weight").alias("w2")), ["chrom", "bin2"]).agg(F.sum(F.col("count") * F.col("w1") * F.col("w2"))).first()[0]
    assert m.pixels("KR").agg(F.sum("v")).first()[0] == pytest.approx(want)


def test_text_in_parts(spark, tmp_path):
    """Several files in order hold what one file holds."""
    rows = spark.range(5000).select(F.lit("c").alias("chrom"), (F.col("id") * 7919 % 5000).alias("start")).withColumn("end", F.col("start") + 1)
    io.write_plain(rows, f"{tmp_path}/one")
    io.write_plain(rows, f"{tmp_path}/many", single=False)
    read = lambda p: [line for f in sorted((tmp_path / p).glob("part-*")) for line in f.read_text().splitlines()]
    assert read("one") == read("many") and len(read("one")) == 5000


def test_result_does_not_depend_on_partitions(spark, sf):
    px, b = views.pixels(spark, sf), views.bins(spark, sf)
    one = pipeline.training_data(px, b, views.RES).collect()
    two = pipeline.training_data(px.repartition(13), b.repartition(3), views.RES).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
