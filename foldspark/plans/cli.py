"""Command line: ``python -m foldspark.plans.cli {hierarchy,domains,features,export-index,plot-tables} ...``. Maps are folders as ``sources.io`` writes them."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.functions.expressions import strip_prefix
from foldspark.operators import calls
from foldspark.plans import plotdata
from foldspark.plans.pipeline import EXCLUDED, Genome, finest
from foldspark.sources import io


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="foldspark")
    sub = top.add_subparsers(dest="tool", required=True)

    def tool(name: str, about: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        p.add_argument("-O", "--output", required=True)
        p.add_argument("--parts", action="store_true", help="leave sorted text as several files, in order, in place of one")
        return p

    def caller(name: str, about: str) -> argparse.ArgumentParser:
        p = tool(name, about)
        p.add_argument("-W", "--weight-col", default="weight", help="balancing column, or RAW")
        p.add_argument("--exclude", nargs="*", default=list(EXCLUDED))
        p.add_argument("-p", "--cpu-core", type=int, default=1, help="shuffle partitions at least")
        p.add_argument("--removeCache", action="store_true")
        p.add_argument("--logFile", default=None)
        return p

    p = caller("hierarchy", "hierarchical domains of one or more replicates")
    p.add_argument("-d", "--datasets", required=True)
    p.add_argument("--minimum-chrom-size", type=int, default=1_000_000)
    p.add_argument("--maxsize", type=int, default=4_000_000)
    p.add_argument("-D", "--DI-col", default="DIs")
    p = caller("domains", "single-level domains of one map")
    p.add_argument("--uri", required=True)
    p.add_argument("-D", "--DI-output", required=True)
    p = tool("features", "aggregation preference of domains")
    p.add_argument("-p", "--path", required=True)
    p.add_argument("-t", "--tad-file", required=True)
    p.add_argument("--balance", default="weight")
    for name, kind, value in (("--pw", int, 2), ("--ww", int, 5), ("--top", float, 0.7), ("--ratio", float, 0.05), ("--gap", float, 0.2)):
        p.add_argument(name, type=kind, default=value)
    p = tool("export-index", "export an index column")
    p.add_argument("-p", "--path", required=True)
    p.add_argument("-D", "--DI-col", default="DIs")
    for flag, name, kind in (("-C", "--chrom", str), ("-S", "--start", int), ("-E", "--end", int)):
        p.add_argument(flag, name, type=kind, default=None)
    p = tool("plot-tables", "tables of a chromosome's plot")
    p.add_argument("-p", "--path", required=True)
    p.add_argument("-T", "--tad-file", required=True)
    p.add_argument("-D", "--DI-col", default="DIs")
    p.add_argument("-C", "--chrom", required=True)
    p.add_argument("-S", "--start", type=int, default=None)
    p.add_argument("-E", "--end", type=int, default=None)
    p.add_argument("-W", "--weight-col", default="weight")
    p.add_argument("--arrowhead", action="store_true", help="arrowhead values in place of contacts")
    p.add_argument("--vmin", type=float, default=None)
    p.add_argument("--vmax", type=float, default=None)
    return top


def _more_partitions(spark: SparkSession, least: int) -> None:
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", str(max(now, least)))


def call_hierarchy(spark: SparkSession, args: argparse.Namespace) -> None:
    _more_partitions(spark, args.cpu_core)
    sets = io.parse_datasets(spark.read.text(args.datasets, wholetext=True).first()[0])
    finest_sets = finest(sets)  # only the finest resolution reaches the output
    maps = [io.open_map(spark, uri, label) for label, uri in sorted(finest_sets.items())]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    bins = union([m.bins.select("dataset", "chrom", "bin", "start", "end") for m in maps])
    genome = Genome(union([m.pixels(args.weight_col) for m in maps]), bins, min(sets), tuple(args.exclude), args.minimum_chrom_size)
    genome.learning()
    io.write_hierarchical(genome.call_hierarchy(args.maxsize), args.output, not args.parts)
    for label, uri in sorted(finest_sets.items()):
        io.put_index(spark, uri, genome.index_track().where(F.col("dataset") == label), args.DI_col)
    if args.removeCache:
        genome.wipe()


def call_domains(spark: SparkSession, args: argparse.Namespace) -> None:
    _more_partitions(spark, args.cpu_core)
    m = io.open_map(spark, args.uri)
    genome = Genome(m.pixels(args.weight_col), m.bins, m.res, tuple(args.exclude))
    genome.learning()
    io.write_plain(genome.call_domains(), args.output, single=not args.parts)
    io.write_bedgraph(io.bedgraph(m.bins, genome.index_track(), m.chroms), args.DI_output, not args.parts)
    if args.removeCache:
        genome.wipe()


def call_features(spark: SparkSession, args: argparse.Namespace) -> None:
    m = io.open_map(spark, args.path)
    bare = lambda d: d.withColumn("chrom", strip_prefix("chrom"))
    tads = bare(io.read_tads(spark, args.tad_file)).join(bare(m.chroms), "chrom").withColumn("end", F.least("end", "length")).where("end > start")
    tads = tads.select(F.lit(m.name).alias("dataset"), "chrom", "start", "end")
    got = calls.domain_features(bare(m.pixels(args.balance)), tads, m.res, pw=args.pw, ww=args.ww, top=args.top, ratio=args.ratio, gap=args.gap)
    io.write_features(got, args.output, not args.parts)


def export_index(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = io.index_rows(io.read_bins(spark, args.path), args.DI_col, args.chrom, args.start, args.end)
    io.write_bedgraph(rows, args.output, not args.parts)


def plot_tables(spark: SparkSession, args: argparse.Namespace) -> None:
    m = io.open_map(spark, args.path)
    track = m.bins.select("chrom", "start", "end", F.col(args.DI_col).alias("di"))
    view = plotdata.chromosome_view(
        m.pixels(args.weight_col), io.read_hierarchical(spark, args.tad_file), track, args.chrom, m.res,
        start=args.start, end=args.end, arrowhead=args.arrowhead, vmin=args.vmin, vmax=args.vmax,
    )
    for name, df in view.items():
        df.write.mode("overwrite").parquet(f"{args.output}/{name}")


TOOLS = {"hierarchy": call_hierarchy, "domains": call_domains, "features": call_features, "export-index": export_index, "plot-tables": plot_tables}


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(filename=getattr(args, "logFile", None), level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName(f"foldspark {args.tool}").getOrCreate()
    logging.info("%s: %s", args.tool, vars(args))
    TOOLS[args.tool](spark, args)
    logging.info("%s: done", args.tool)


if __name__ == "__main__":
    main()
