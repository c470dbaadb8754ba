"""Queries over domain calls, alignment, consensus and features: sequential steps without an SQL form, unless noted."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.operators import calls, matrix, scores, tracks
from foldspark.operators.sequences import Mixture
from foldspark.plans.pipeline import Genome, training_data
from foldspark.queries import query, views
from foldspark.queries.maps import RUNS, SCORE, run_bottoms
from foldspark.queries.views import B, BINS, C2, DEFAULT, RES

ROUNDS = 200


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, b = views.pixels(spark, sf_dir), views.bins(spark, sf_dir)
    return tracks.trim(tracks.directionality(px, calls.adaptive_windows(px, b, DEFAULT), DEFAULT, DEFAULT))


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.fit_models(training_data(views.pixels(spark, sf_dir), views.bins(spark, sf_dir), RES), ROUNDS)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _track(spark, sf_dir)
    return tracks.region_values(t, tracks.gap_free_regions(t, RES))


@query()
def adaptive_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.adaptive_windows(views.pixels(spark, sf_dir), views.bins(spark, sf_dir), DEFAULT)


@query()
def di_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _track(spark, sf_dir)


@query()
def hmm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir)


@query()
def viterbi_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.state_paths(_values(spark, sf_dir), _models(spark, sf_dir))


@query()
def bottom_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.bottom_domains(_values(spark, sf_dir), _models(spark, sf_dir))


@query()
def single_level_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Genome(views.pixels(spark, sf_dir), views.bins(spark, sf_dir), RES).call_domains()


@query()
def hierarchical_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Genome(views.pixels(spark, sf_dir), views.bins(spark, sf_dir), RES).call_hierarchy()


@query()
def consensus_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.pixels(spark, sf_dir, 0).unionByName(views.pixels(spark, sf_dir, 1))
    b = views.bins(spark, sf_dir, "rep0").unionByName(views.bins(spark, sf_dir, "rep1"))
    return Genome(px, b, RES).call_hierarchy()


# the greatest value of a partition of the first k blocks of ten bins, for k = 0, 1, ...: bins times score of the last run, and the best before it
_PARTITIONS = f"""WITH RECURSIVE {B}, r AS (SELECT 0 AS k, [CAST(0 AS DOUBLE)] AS v UNION ALL
SELECT k + 1, list_append(v, list_max(list_transform(range(0, k + 1), lambda j: v[j + 1] + (k + 1 - j) * 10 * ((j * 70 + (k + 1) * 30) % 11 - 4) / 10.0))) FROM r WHERE k < {BINS // 10})
SELECT chrom, round(max(v[{BINS // 10} + 1]), 6) AS best FROM r, (SELECT DISTINCT chrom FROM bins) WHERE k = {BINS // 10} GROUP BY chrom"""


@query(_PARTITIONS)
def run_partition_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest value of a partition into runs, on a fixed score table."""
    d = views.planted_domains(spark, sf_dir, 10).select("dataset", "chrom", F.lit(0).cast("bigint").alias("region"), F.col("start_bin").alias("start"), F.col("end_bin").alias("end"))
    far = d.select("chrom", F.col("start").alias("s2"), F.col("end").alias("e2"))
    table = d.join(far, "chrom").where("s2 >= start").select("dataset", "chrom", "region", "start", F.col("e2").alias("end"), (((F.col("start") * 7 + F.col("e2") * 3) % 11 - 4) / 10).alias("score"))
    runs = calls.segment_runs(d, table, 1).join(table, ["dataset", "chrom", "region", "start", "end"])
    return runs.groupBy("chrom").agg(F.round(F.sum((F.col("end") - F.col("start")) * F.col("score")), 6).alias("best"))


@query()
def aligned_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.align_sets(views.hierarchy(spark, sf_dir, 0), views.hierarchy(spark, sf_dir, 1), 1)


@query()
def inner_changed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.align_sets(views.hierarchy(spark, sf_dir, 0), views.hierarchy(spark, sf_dir, 2), 1, {"inner_changed"})


@query()
def aligned_all_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [views.hierarchy(spark, sf_dir, k) for k in (0, 1, 2)]
    got = calls.align_all(sets[0].unionByName(sets[1]).unionByName(sets[2]), 1)
    return got.groupBy("tn", "qn", "kind").agg(F.count("*").alias("n"))


@query()
def aggregation_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.planted_domains(spark, sf_dir, 40).select("dataset", "chrom", (F.col("start_bin") * RES).alias("start"), (F.col("end_bin") * RES).alias("end"))
    return calls.domain_features(views.pixels(spark, sf_dir), d, RES)


@query(f"""WITH {B} SELECT 'd' AS dataset, chrom, bin, CASE WHEN bin < {BINS // 2} THEN CAST(bin AS DOUBLE) ELSE 0.0 END AS di, s AS start, e AS "end", w AS weight FROM bins""")
def index_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldspark.sources.io import with_index_column

    b = views.bins(spark, sf_dir)
    t = b.where(F.col("bin") < BINS // 2).select("dataset", "chrom", "bin", F.col("bin").cast("double").alias("di"))
    return with_index_column(b, t)


@query(f"""WITH {B} SELECT 'chr' || chrom AS chrom, s AS start, least(e, {BINS * RES - 1000}) AS "end", printf('%.4g', bin * 1234.5678) AS di FROM bins""")
def index_bedgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldspark.sources.io import bedgraph

    b = views.bins(spark, sf_dir)
    chroms = b.select("chrom").distinct().withColumn("length", F.lit(BINS * RES - 1000))
    return bedgraph(b, b.select("dataset", "chrom", "bin", (F.col("bin") * 1234.5678).alias("di")), chroms)


@query()
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation_preference(spark, sf_dir).where("ap >= 0").groupBy("chrom").agg(F.avg("cover").alias("cover"), F.sum("n_points").alias("n_points"))


@query()
def gap_free_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.pixels(spark, sf_dir).where("bin1 % 3 <> 1 and bin2 % 3 <> 1")
    return matrix.drop_gaps(px)


@query()
def decay_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed decay of contacts over distance; held against another spline in the tests."""
    got = calls.decay_fit(matrix.distance_decay(views.pixels(spark, sf_dir), views.sizes(spark, sf_dir)))
    return got.select("dataset", "chrom", "d", F.round("mean_v", 6).alias("mean_v"), F.round("fit", 6).alias("fit"))


# the best partition of the first k blocks, with the place where its last run begins; then back from the end
_TADS = f"""WITH RECURSIVE {C2}, {B}, {RUNS}, {SCORE}, sm AS (SELECT chrom, map_from_entries(list({{'k': s * 1000 + e, 'v': score}})) AS m FROM sc GROUP BY chrom),
r AS (SELECT chrom, m, 0 AS k, [CAST(0 AS DOUBLE)] AS v, [0] AS f FROM sm UNION ALL
  SELECT chrom, m, k + 1, list_append(v, b.x), list_append(f, CAST(-b.j AS INT)) FROM (SELECT *, list_max(list_transform(range(0, k + 1), lambda j:
    {{'x': coalesce(v[j + 1] + (k + 1 - j) * 10 * m[j * 10000 + (k + 1) * 10], CAST('-inf' AS DOUBLE)), 'j': -j}})) AS b FROM r WHERE k < {BINS // 10})),
w AS (SELECT chrom, f, {BINS // 10} AS e FROM r WHERE k = {BINS // 10}), t AS (SELECT chrom, f, f[e + 1] AS s, e FROM w UNION ALL SELECT chrom, f, f[s + 1], s FROM t WHERE s > 0)
SELECT 'd' AS dataset, chrom, CAST(s * 10 AS BIGINT) AS start, CAST(e * 10 AS BIGINT) AS "end", CAST(e - s AS BIGINT) AS members FROM t"""


@query(_TADS)
def tads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of bottom domains that make the best partition by their contrasts."""
    bottoms = run_bottoms(spark, sf_dir)
    table = scores.run_scores(views.pixels(spark, sf_dir), bottoms, 40).withColumn("region", F.lit(0).cast("bigint"))
    table = table.withColumnsRenamed({"start_bin": "start", "end_bin": "end"})
    spans = bottoms.select("dataset", "chrom", F.col("region").cast("bigint").alias("region"), F.col("start_bin").alias("start"), F.col("end_bin").alias("end"))
    return calls.segment_runs(spans, table, 1).select("dataset", "chrom", "start", "end", "members")


# a track that turns from negative to positive every 18 bins, with some disorder
_WAVE = "CAST(bin % 18 - 9 AS DOUBLE) * (1 + bin * 37 % 11) / 5.0 + bin * 53 % 7 / 3.0 - 1"


def _viterbi_sql() -> str:
    """The best path into every state, bin by bin, with the start values of the model written out; ties go to the smaller state."""
    m = Mixture.initial()
    density = lambda q: " + ".join(
        f"{w!r} * exp(-0.5 * pow((di - ({mu!r})) / {sd!r}, 2)) / ({sd!r} * sqrt(2 * pi()))" for w, mu, sd in zip(m.weight[q].tolist(), m.mean[q].tolist(), m.sd[q].tolist(), strict=True)
    )
    move = "[" + ", ".join("[" + ", ".join(repr(math.log(x)) if x > 0 else "-1e300" for x in row) + "]" for row in m.trans.tolist()) + "]"
    best = f"list_max(list_transform(range(0, 4), lambda p: {{'x': v[p + 1] + {move}[p + 1][q + 1], 'p': -p}}))"
    return f"""WITH RECURSIVE {B}, x AS (SELECT chrom, bin, {_WAVE} AS di FROM bins), em AS (SELECT chrom, bin, [{", ".join(f"ln({density(q)})" for q in range(4))}] AS b FROM x),
r AS (SELECT chrom, bin, [b[1], -1e300, -1e300, -1e300] AS v, ['0', '1', '2', '3'] AS p FROM em WHERE bin = 0 UNION ALL
  SELECT r.chrom, em.bin, list_transform(range(0, 4), lambda q: {best}.x + b[q + 1]), list_transform(range(0, 4), lambda q: r.p[1 - {best}.p] || q)
  FROM r JOIN em ON em.chrom = r.chrom AND em.bin = r.bin + 1),
z AS (SELECT chrom, p[4] AS p FROM r WHERE bin = {BINS - 1}), c AS (SELECT chrom, p, unnest(range(0, {BINS})) AS bin FROM z)
SELECT 'd' AS dataset, chrom, CAST(0 AS BIGINT) AS start_bin, CAST(bin AS BIGINT) AS bin, CAST(p[bin + 1] AS BIGINT) AS state FROM c"""


@query(_viterbi_sql())
def viterbi_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest states under the start values of the model."""
    rows = views.bins(spark, sf_dir).select("dataset", "chrom", F.lit(0).cast("bigint").alias("start_bin"), "bin", F.expr(_WAVE).alias("di"))
    return calls.state_paths(rows, spark.createDataFrame([("d", calls.model_to_json(Mixture.initial()))], "dataset string, model string"))
