"""Queries over contact matrices and per-bin tracks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.functions import expressions as X
from foldspark.operators import matrix, scores, tracks
from foldspark.plans import plotdata
from foldspark.queries import query, views
from foldspark.queries.views import B, BINS, C1, C2, DEFAULT, RES
from foldspark.sources.kept import Kept


def _r(name: str, digits: int = 6):
    return (F.round(name, digits) + 0.0).alias(name)


@query(f"WITH {C1} SELECT 'd' AS dataset, chrom, bin1, bin2, count AS v FROM c1")
def contacts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.balance(views.raw(spark, sf_dir), views.bins(spark, sf_dir), None)


@query(f"WITH {C1}, {B} SELECT 'd' AS dataset, c1.chrom, bin1, bin2, round(count * x.w * y.w, 6) AS v FROM c1 JOIN bins x ON x.chrom = c1.chrom AND x.bin = bin1 JOIN bins y ON y.chrom = c1.chrom AND y.bin = bin2")
def contacts_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.balance(views.raw(spark, sf_dir), views.bins(spark, sf_dir)).withColumn("v", F.round("v", 6))


@query(f"WITH {C2} SELECT chrom, count(*) AS cells, sum(v) AS total, min(bin2 - bin1) AS least FROM c2 WHERE bin1 <= bin2 AND v <> 0 AND chrom <> 'N' GROUP BY 1")
def contacts_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = matrix.exclude_chroms(matrix.upper(matrix.finite(views.pixels(spark, sf_dir))), ["N"])
    return got.groupBy("chrom").agg(F.count("*").alias("cells"), F.sum("v").alias("total"), F.min(F.col("bin2") - F.col("bin1")).alias("least"))


@query(f"""WITH {C2}, s AS (SELECT chrom, bin1, bin2, v FROM c2 UNION ALL SELECT chrom, bin2, bin1, v FROM c2 WHERE bin1 <> bin2)
SELECT 'd' AS dataset, * FROM s WHERE bin1 >= 40 AND bin1 < 60 AND bin2 >= 40 AND bin2 < 60""")
def submatrix_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.symmetric(matrix.region(views.pixels(spark, sf_dir), 40, 60))


@query(f"""WITH {C2} SELECT 'd' AS dataset, chrom, bin1, bin2, v FROM c2 WHERE bin1 >= 3 AND bin2 < 11 AND chrom = 'A'
UNION ALL SELECT 'd', chrom, bin2, bin1, v FROM c2 WHERE bin1 >= 3 AND bin2 < 11 AND chrom = 'A' AND bin1 <> bin2""")
def region_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.pixels(spark, sf_dir).where("chrom = 'A'")
    chroms = spark.createDataFrame([("A", 11 * RES)], "chrom string, length bigint")
    return matrix.symmetric(matrix.clipped_region(px, chroms, RES, 3 * RES, 10**12))


@query("""WITH r AS (SELECT l_returnflag AS chrom, l_suppkey % 60 AS a, l_linenumber * 7 AS b, l_quantity AS v FROM lineitem),
q AS (SELECT chrom, least(a, b) AS a, greatest(a, b) AS b, v FROM r)
SELECT 'd' AS dataset, chrom, CAST(a - 5 AS BIGINT) AS bin1, CAST(b - 5 AS BIGINT) AS bin2, CAST(sum(v) AS DOUBLE) AS v FROM q WHERE a >= 5 AND b < 50 GROUP BY ALL""")
def records_to_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rec = li.select(
        F.lit("d").alias("dataset"), F.col("l_returnflag").alias("chrom"), (F.col("l_suppkey") % 60).cast("bigint").alias("bin1"), (F.col("l_linenumber") * 7).cast("bigint").alias("bin2"), F.col("l_quantity").cast("double").alias("v")
    )
    return matrix.from_records(rec, 5, 50)


@query(f"WITH {C2}, {B}, n AS (SELECT chrom, count(*) AS n FROM bins GROUP BY 1) SELECT chrom, count(*) AS cells FROM c2 WHERE chrom NOT IN (SELECT chrom FROM n WHERE n * {RES} < 8000000 OR chrom = 'R') GROUP BY 1")
def exclude_small_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.bins(spark, sf_dir).where("chrom <> 'R' or bin < 50")
    return matrix.exclude_small(views.pixels(spark, sf_dir), b, RES, 8_000_000).groupBy("chrom").agg(F.count("*").alias("cells"))


@query(f"WITH {C2} SELECT 'd' AS dataset, chrom, CAST(count(*) AS BIGINT) AS cells FROM c2 WHERE chrom NOT IN ('A') GROUP BY 2")
def exclude_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.exclude_chroms(views.pixels(spark, sf_dir), ["A"]).groupBy("dataset", "chrom").agg(F.count("*").alias("cells"))


@query(f"""WITH {C2}, g AS (SELECT DISTINCT chrom, d FROM c2, (SELECT unnest(range(0, {BINS})) AS d))
SELECT 'd' AS dataset, g.chrom, g.d, round(coalesce(sum(v), 0) / ({BINS} - g.d), 6) AS mean_v FROM g LEFT JOIN c2 ON c2.chrom = g.chrom AND bin2 - bin1 = d GROUP BY g.chrom, g.d""")
def distance_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.distance_decay(views.pixels(spark, sf_dir), views.sizes(spark, sf_dir)).withColumn("mean_v", F.round("mean_v", 6))


@query(f"""WITH {C2}, s AS (SELECT chrom, v / 64 AS v FROM c2 UNION ALL SELECT chrom, v / 64 FROM c2 WHERE bin1 <> bin2),
m AS (SELECT chrom, quantile_cont(v, 0.5) AS m, min(v) AS l FROM s GROUP BY 1) SELECT 'd' AS dataset, chrom, m AS median_v, CASE WHEN m < 1 THEN l ELSE 1.0 END AS factor FROM m""")
def rescale_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.rescale_factor(views.pixels(spark, sf_dir).withColumn("v", F.col("v") / 64))


# a map with gaps: every third bin has no contacts
_SPARSE = "f AS (SELECT chrom, bin1, bin2, v FROM c2 WHERE bin1 % 3 <> 1 AND bin2 % 3 <> 1)"


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pixels(spark, sf_dir).where("bin1 % 3 <> 1 and bin2 % 3 <> 1")


@query(f"""WITH {C2}, {_SPARSE}, t AS (SELECT chrom, bin1 AS b FROM f UNION SELECT chrom, bin2 FROM f)
SELECT 'd' AS dataset, chrom, round(1 - count(*) / {BINS}, 6) AS gap_ratio FROM t GROUP BY chrom""")
def gap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.gap_ratio(_sparse(spark, sf_dir), views.sizes(spark, sf_dir)).withColumn("gap_ratio", F.round("gap_ratio", 6))


@query(f"""WITH {C2}, {_SPARSE}, t AS (SELECT chrom, bin1 AS bin FROM f UNION SELECT chrom, bin2 FROM f)
SELECT 'd' AS dataset, chrom, bin, row_number() OVER (PARTITION BY chrom ORDER BY bin) - 1 AS idx FROM t""")
def gap_free_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.gap_free_index(_sparse(spark, sf_dir))


@query(f"WITH {C2}, {_SPARSE} SELECT 'd' AS dataset, * FROM f")
def gaps_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _sparse(spark, sf_dir)
    return matrix.restore_gaps(matrix.drop_gaps(px), matrix.gap_free_index(px))


_ARMS = f"""arms AS (SELECT chrom, bin1 AS bin, bin2 - bin1 AS d, 0.0 AS up, v AS down FROM c2 WHERE bin2 - bin1 > 1
  UNION ALL SELECT chrom, bin2, bin2 - bin1, v, 0.0 FROM c2 WHERE bin2 - bin1 > 1),
grid AS (SELECT bins.chrom, bin, d FROM bins, (SELECT unnest(range(2, {DEFAULT})) AS d)),
vec AS (SELECT grid.chrom, grid.bin, grid.d, coalesce(sum(up), 0.0) AS up, coalesce(sum(down), 0.0) AS down FROM grid LEFT JOIN arms USING (chrom, bin, d) GROUP BY ALL)"""


def _di_sql(window: str, name: str) -> str:
    """The bias of every bin over offsets below ``window``, from the dense vectors."""
    return f"""{name}_n AS (SELECT chrom, bin, count(*) FILTER (up <> 0 AND down <> 0) AS j FROM vec WHERE d < {window} GROUP BY ALL),
{name}_v AS (SELECT vec.* FROM vec JOIN {name}_n USING (chrom, bin) WHERE d < {window} AND (j < 5 OR (up <> 0 AND down <> 0))),
{name} AS (SELECT chrom, bin, CASE WHEN count(*) <= 1 OR var_samp(up) + var_samp(down) < 1e-12 THEN 0.0
  ELSE (avg(up) - avg(down)) / sqrt((var_samp(up) + var_samp(down)) / count(*)) END AS di FROM {name}_v GROUP BY ALL)"""


def _fixed(spark: SparkSession, sf_dir: str, w: int) -> DataFrame:
    return views.bins(spark, sf_dir).select("dataset", "chrom", "bin", F.lit(w).alias("w"))


@query(f"WITH {C2}, {B}, {_ARMS} SELECT 'd' AS dataset, chrom, bin, d, up, down FROM vec WHERE up <> 0 OR down <> 0")
def arm_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.arms(views.pixels(spark, sf_dir), DEFAULT)


@query(f"WITH {C2}, {B}, {_ARMS}, {_di_sql('15', 'a')} SELECT 'd' AS dataset, chrom, bin, round(di, 6) + 0.0 AS di FROM a")
def di_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.directionality(views.pixels(spark, sf_dir), _fixed(spark, sf_dir, 15), 15, 15).select("dataset", "chrom", "bin", _r("di"))


_FALLBACK = "CASE WHEN bin % 5 = 0 THEN 3 WHEN bin % 5 = 1 THEN 0 ELSE 15 END"
_FALLBACK_SQL = f"""{_di_sql('15', 'a')}, {_di_sql('3', 's')}, {_di_sql(str(DEFAULT), 'b')},
fb AS (SELECT b.chrom, b.bin, CASE b.bin % 5 WHEN 0 THEN CASE WHEN s.di <> 0 THEN s.di ELSE b.di END WHEN 1 THEN b.di ELSE CASE WHEN a.di <> 0 THEN a.di ELSE b.di END END AS di
  FROM b JOIN a USING (chrom, bin) JOIN s USING (chrom, bin))"""


def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.bins(spark, sf_dir).select("dataset", "chrom", "bin", F.expr(_FALLBACK).alias("w"))
    return tracks.directionality(views.pixels(spark, sf_dir), w, DEFAULT, DEFAULT)


@query(f"WITH {C2}, {B}, {_ARMS}, {_FALLBACK_SQL} SELECT 'd' AS dataset, chrom, bin, round(di, 6) + 0.0 AS di FROM fb")
def di_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fallback(spark, sf_dir).select("dataset", "chrom", "bin", _r("di"))


@query(f"""WITH {C2}, {B}, {_ARMS}, {_FALLBACK_SQL},
q AS (SELECT chrom, quantile_cont(di, 0.001) FILTER (di < 0) AS lo, quantile_cont(di, 0.999) FILTER (di > 0) AS hi FROM fb GROUP BY 1)
SELECT 'd' AS dataset, chrom, bin, round(CASE WHEN di < lo THEN lo WHEN di > hi THEN hi ELSE di END, 6) + 0.0 AS di FROM fb JOIN q USING (chrom)""")
def di_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.trim(_fallback(spark, sf_dir)).select("dataset", "chrom", "bin", _r("di"))


@query(f"""WITH {C2}, {B}, {_ARMS}, o AS (SELECT chrom, bin, d, avg(CASE WHEN up < down THEN 1.0 ELSE 0.0 END) OVER w AS a, avg(CASE WHEN up > down THEN 1.0 ELSE 0.0 END) OVER w AS b
FROM vec WINDOW w AS (PARTITION BY chrom, bin ORDER BY d ROWS UNBOUNDED PRECEDING))
SELECT 'd' AS dataset, chrom, bin, d, round(a, 6) AS down_fraction, round(b, 6) AS up_fraction FROM o""")
def bias_running_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tracks.offset_grid(views.pixels(spark, sf_dir), views.bins(spark, sf_dir), DEFAULT)
    return tracks.bias_fractions(grid).select("dataset", "chrom", "bin", "d", _r("down_fraction"), _r("up_fraction"))


@query(f"""WITH {C2}, {B}, {_ARMS}, x AS (SELECT chrom, bin, d, CAST(up > down AS INT) AS x FROM vec), l AS (SELECT *, lag(x) OVER (PARTITION BY chrom, bin ORDER BY d) AS y FROM x),
p AS (SELECT chrom, bin, y, x, count(*) AS n FROM l WHERE y IS NOT NULL GROUP BY ALL),
c AS (SELECT chrom, bin, sum(n) AS t, sum(n * n) AS q FROM p GROUP BY ALL)
SELECT 'd' AS dataset, chrom, bin, round(CAST(4 * q / t - t AS DOUBLE), 6) AS chi2, 4 * q / t - t >= 7.814727903251179 AS reject FROM c""")
def bias_transition_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tracks.offset_grid(views.pixels(spark, sf_dir), views.bins(spark, sf_dir), DEFAULT)
    return tracks.transition_test(grid).select("dataset", "chrom", "bin", _r("chi2"), "reject")


_IS = f"""{B}, si AS (SELECT bins.chrom, bin, coalesce(sum(v), 0) / 25.0 AS score FROM bins LEFT JOIN c2 ON c2.chrom = bins.chrom AND bin1 >= bin - 5 AND bin1 < bin AND bin2 > bin AND bin2 <= bin + 5 GROUP BY ALL)"""


@query(f"WITH {C2}, {_IS} SELECT 'd' AS dataset, chrom, bin, round(score, 6) AS score FROM si")
def insulation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.insulation(views.pixels(spark, sf_dir), views.bins(spark, sf_dir)).select("dataset", "chrom", "bin", _r("score"))


@query(f"""WITH {C2}, {_IS}, n AS (SELECT x.chrom, x.bin, y.bin AS z, row_number() OVER (PARTITION BY x.chrom, x.bin ORDER BY y.score, y.bin) AS k
  FROM bins x JOIN si y ON x.chrom = y.chrom AND abs(x.bin - y.bin) <= 1 WHERE x.bin % 10 = 0) SELECT 'd' AS dataset, chrom, bin, z AS refined FROM n WHERE k = 1""")
def boundary_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.bins(spark, sf_dir)
    at = b.where("bin % 10 = 0").select("dataset", "chrom", "bin")
    return tracks.refine_boundaries(at, tracks.insulation(views.pixels(spark, sf_dir), b))


# a track with gaps: the fixed-window index, set to 0 in some stretches of chromosomes A and N
_ZEROED = "CASE WHEN chrom = 'A' AND bin >= 60 AND bin < 80 THEN 0 WHEN chrom = 'N' AND (bin < 30 OR bin >= 100 AND bin < 104 OR bin >= 120 AND bin < 131) THEN 0 ELSE 1.5 + bin % 7 END"
_ISLANDS = f"""{B}, tr AS (SELECT chrom, bin, {_ZEROED} AS di FROM bins), nz AS (SELECT *, bin - lag(bin) OVER (PARTITION BY chrom ORDER BY bin) AS gap FROM tr WHERE di <> 0),
isl AS (SELECT chrom, bin, sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY bin) AS k FROM nz),
ie AS (SELECT chrom, k, min(bin) AS s, max(bin) AS l, count(*) OVER (PARTITION BY chrom) AS n FROM isl GROUP BY chrom, k),
reg AS (SELECT chrom, s, CASE WHEN n = 1 THEN l ELSE l + 1 END AS e FROM ie WHERE CASE WHEN n = 1 THEN l ELSE l + 1 END - s > 10)"""


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bins(spark, sf_dir).select("dataset", "chrom", "bin", F.expr(_ZEROED).cast("double").alias("di"))


@query(f"WITH {_ISLANDS} SELECT 'd' AS dataset, chrom, s AS start_bin, e AS end_bin FROM reg")
def gap_free_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.gap_free_regions(_gappy(spark, sf_dir), RES)


@query(f"WITH {_ISLANDS} SELECT 'd' AS dataset, chrom, bin FROM bins b WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.chrom = b.chrom AND bin >= s AND bin < e)")
def gap_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.gap_bins(views.bins(spark, sf_dir), tracks.gap_free_regions(_gappy(spark, sf_dir), RES))


@query(f"""WITH {_ISLANDS} SELECT 'd' AS dataset, reg.chrom, s AS start_bin, e AS end_bin, CAST(count(*) AS BIGINT) AS n_values, CAST(sum(di) AS DOUBLE) AS total FROM reg JOIN tr ON tr.chrom = reg.chrom AND bin >= s AND bin < e AND di <> 0
GROUP BY ALL HAVING count(*) > 20""")
def training_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _gappy(spark, sf_dir)
    got = tracks.training_sequences(t, tracks.gap_free_regions(t, RES))
    return got.select("dataset", "chrom", "start_bin", "end_bin", F.size("seq").cast("bigint").alias("n_values"), F.aggregate("seq", F.lit(0.0), lambda a, x: a + x).alias("total"))


_DOM = f"dom AS (SELECT chrom, bin AS s, bin + 20 AS e FROM bins WHERE bin % 20 = 0)"


@query(f"""WITH {C1}, {B}, {_DOM}, f AS (SELECT dom.chrom, s, e, count(bin1) AS n FROM dom LEFT JOIN c1 ON c1.chrom = dom.chrom AND bin1 >= s AND bin2 < e AND bin2 - bin1 > 1 GROUP BY ALL)
SELECT 'd' AS dataset, chrom, s AS start_bin, e AS end_bin, round(1 - 2 * n / (19.0 * 18), 6) AS noise FROM f""")
def domain_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.domain_noise(views.pixels(spark, sf_dir), views.planted_domains(spark, sf_dir)).withColumn("noise", F.round("noise", 6))


SCORE = """ins AS (SELECT dom.chrom, s, e, bin1 AS x, bin2 AS y, bin2 - bin1 AS d, v FROM dom JOIN c2 ON c2.chrom = dom.chrom AND bin1 >= s AND bin2 < e AND bin2 - bin1 > 1),
pr AS (SELECT ins.chrom, s, e, ins.v AS i, o.v AS o FROM ins JOIN c2 o ON o.chrom = ins.chrom AND o.bin1 = x - d AND o.bin2 = x WHERE x - d <= s
  UNION ALL SELECT ins.chrom, s, e, ins.v, o.v FROM ins JOIN c2 o ON o.chrom = ins.chrom AND o.bin1 = y AND o.bin2 = y + d WHERE y + d >= e),
sc AS (SELECT dom.chrom, dom.s, dom.e, CASE WHEN count(i) > 3 THEN avg(0.5 * (i - o) / (i + o)) ELSE 0.0 END AS score FROM dom LEFT JOIN pr USING (chrom, s, e) GROUP BY ALL)"""


@query(f"WITH {C2}, {B}, {_DOM}, {SCORE} SELECT 'd' AS dataset, chrom, s AS start_bin, e AS end_bin, round(score, 6) + 0.0 AS score FROM sc")
def domain_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scores.domain_contrast(views.pixels(spark, sf_dir), views.planted_domains(spark, sf_dir))
    return got.select("dataset", "chrom", "start_bin", "end_bin", _r("score"))


RUNS = """bt AS (SELECT chrom, bin AS s, bin + 10 AS e, CASE WHEN bin % 70 = 0 THEN 0.3 ELSE 0.1 END AS q FROM bins WHERE bin % 10 = 0),
dom AS (SELECT chrom, s, e FROM bt UNION SELECT a.chrom, a.s, b.e FROM bt a JOIN bt b ON a.chrom = b.chrom AND b.s > a.s AND b.e - a.s <= 40 AND a.q <= 0.2 AND b.q <= 0.2)"""


def run_bottoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.planted_domains(spark, sf_dir, 10)
    return rows.withColumns({"region": F.lit(0), "noise": F.when(F.col("start_bin") % 70 == 0, 0.3).otherwise(0.1)})


@query(f"WITH {C2}, {B}, {RUNS}, {SCORE} SELECT 'd' AS dataset, chrom, s AS start_bin, e AS end_bin, round(score, 6) + 0.0 AS score FROM sc")
def domain_run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.run_scores(views.pixels(spark, sf_dir), run_bottoms(spark, sf_dir), 40).select("dataset", "chrom", "start_bin", "end_bin", _r("score"))


_ARROW = """tri AS (SELECT dom.chrom, s, e, a.i AS x, b.i AS y FROM dom, (SELECT unnest(range(0, 200)) AS i) a, (SELECT unnest(range(0, 200)) AS i) b WHERE a.i >= s AND a.i < b.i AND b.i < e),
ah AS (SELECT tri.*, coalesce(u.v, 0) AS up, coalesce(h.v, 0) AS here FROM tri LEFT JOIN c2 u ON u.chrom = tri.chrom AND u.bin1 = 2 * x - y AND u.bin2 = x LEFT JOIN c2 h ON h.chrom = tri.chrom AND h.bin1 = x AND h.bin2 = y),
av AS (SELECT chrom, s, e, x, y, up + here AS t, CASE WHEN up + here = 0 THEN 0.0 ELSE (up - here) / (up + here) END AS a FROM ah)"""


@query(f"WITH {C2}, {B}, {_DOM}, {_ARROW} SELECT 'd' AS dataset, chrom, s AS start_bin, e AS end_bin, x, y, round(a, 6) + 0.0 AS a FROM av WHERE t > 0")
def arrowhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scores.arrowhead(views.pixels(spark, sf_dir), views.planted_domains(spark, sf_dir))
    return got.select("dataset", "chrom", "start_bin", "end_bin", "x", "y", _r("a"))


@query(f"""WITH {C2}, {B}, {_DOM}, {_ARROW}, k AS (SELECT chrom, s, e, s + o AS o, s + o + 10 AS f FROM dom, (SELECT unnest([0, 5, 10]) AS o)),
p AS (SELECT k.chrom, k.s, k.e, o, f, a AS p FROM k JOIN av USING (chrom, s, e) WHERE y - x > 1 AND abs(a) <> 1 AND y >= f AND x < f AND 2 * x - y >= o
  UNION ALL SELECT k.chrom, k.s, k.e, o, f, -a FROM k JOIN av USING (chrom, s, e) WHERE y - x > 1 AND abs(a) <> 1 AND y < f AND x >= o AND 2 * x - y >= s AND 2 * x - y <= o)
SELECT 'd' AS dataset, chrom, s AS start_bin, e AS end_bin, o AS o_bin, f AS e_bin, round(CASE WHEN count(p) > 3 THEN avg(0.5 * p) ELSE 0.0 END, 6) + 0.0 AS score FROM k LEFT JOIN p USING (chrom, s, e, o, f) GROUP BY chrom, s, e, o, f""")
def subdomain_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = views.planted_domains(spark, sf_dir)
    keys = outer.select("*", F.explode(F.array(*map(F.lit, (0, 5, 10)))).alias("k")).select("*", (F.col("start_bin") + F.col("k")).alias("o_bin"), (F.col("start_bin") + F.col("k") + 10).alias("e_bin"))
    got = scores.subdomain_scores(views.pixels(spark, sf_dir), outer, keys)
    return got.select("dataset", "chrom", "start_bin", "end_bin", "o_bin", "e_bin", _r("score"))


@query(f"WITH {B}, {_DOM} SELECT 'd' AS dataset, dom.chrom, bin, greatest(bin - dom.s + 1, dom.e - bin) AS w FROM dom JOIN bins ON bins.chrom = dom.chrom AND bin >= dom.s AND bin < dom.e")
def window_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.window_update(views.planted_domains(spark, sf_dir))


_STATE = "CASE WHEN bin % 8 = 0 THEN 0 WHEN bin % 8 < 4 THEN 1 WHEN bin % 8 < 7 THEN 2 ELSE 3 END"


@query(f"""WITH {B}, p AS (SELECT chrom, bin, {_STATE} AS st FROM bins), l AS (SELECT *, lag(st) OVER (PARTITION BY chrom ORDER BY bin) AS q FROM p),
b AS (SELECT chrom, bin FROM l WHERE q = 3 AND st = 0 UNION SELECT DISTINCT chrom, 0 FROM bins UNION SELECT DISTINCT chrom, {BINS} FROM bins),
n AS (SELECT chrom, bin, lead(bin) OVER (PARTITION BY chrom ORDER BY bin) AS e FROM b) SELECT 'd' AS dataset, chrom, CAST(0 AS BIGINT) AS start_bin, CAST(bin AS BIGINT) AS domain_start, CAST(e AS BIGINT) AS domain_end FROM n WHERE e IS NOT NULL""")
def path_to_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = views.bins(spark, sf_dir).select("dataset", "chrom", F.lit(0).cast("bigint").alias("start_bin"), "bin", F.expr(_STATE).alias("state"))
    return tracks.boundaries_to_domains(tracks.path_boundaries(path))


# stencils over all cells at least five off the diagonal
_CELLS = f"""dec AS (SELECT chrom, d, sum(v) / ({BINS} - d) AS m FROM (SELECT chrom, bin2 - bin1 AS d, v FROM c2) GROUP BY chrom, d),
cel AS (SELECT ch.chrom, a.i, b.i AS j FROM (SELECT DISTINCT chrom FROM c2) ch, (SELECT unnest(range(0, {BINS})) AS i) a, (SELECT unnest(range(0, {BINS})) AS i) b WHERE b.i - a.i >= 5),
oe AS (SELECT cel.chrom, cel.i, cel.j, coalesce(v, 0) AS o, coalesce(m, 0) AS e FROM cel LEFT JOIN c2 ON c2.chrom = cel.chrom AND bin1 = i AND bin2 = j LEFT JOIN dec ON dec.chrom = cel.chrom AND dec.d = cel.j - cel.i)"""
_DONUT = f"""{_CELLS}, off AS (SELECT x.k AS a, y.k AS b FROM (SELECT unnest(range(-5, 6)) AS k) x, (SELECT unnest(range(-5, 6)) AS k) y WHERE x.k <> 0 AND y.k <> 0 AND NOT (abs(x.k) <= 2 AND abs(y.k) <= 2)),
snt AS (SELECT chrom, i - a AS i, j - b AS j, sum(o) AS seen, sum(e) AS hoped FROM oe, off GROUP BY ALL),
dn AS (SELECT oe.chrom, oe.i, oe.j, seen, hoped FROM oe LEFT JOIN snt USING (chrom, i, j))"""


def _map_cells(spark: SparkSession, sf_dir: str, *wanted: str, **made: Callable[[dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
    # read for the decay and for the cells: the contacts are counted once
    px, n = Kept(spark, "pixels").table(views.pixels(spark, sf_dir)), views.sizes(spark, sf_dir)
    return scores.every_cell(px, n, matrix.distance_decay(px, n), list(wanted), made=made)


@query(f"WITH {C2}, {_DONUT} SELECT 'd' AS dataset, chrom, i, j, round(coalesce(seen, 0), 6) AS seen, round(coalesce(hoped, 0), 6) AS hoped FROM dn")
def donut_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map_cells(spark, sf_dir, "seen", "hoped").select("dataset", "chrom", "i", "j", _r("seen"), _r("hoped"))


@query(f"""WITH {C2}, {_DONUT} SELECT 'd' AS dataset, dn.chrom, dn.i, dn.j, round(e * coalesce(seen, 0) / CASE WHEN coalesce(hoped, 0) = 0 THEN 1 ELSE hoped END, 5) AS corrected FROM dn JOIN oe USING (chrom, i, j)""")
def corrected_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected contacts scaled by their surroundings."""
    return scores.corrected_expected(_map_cells(spark, sf_dir, "e", "seen", "hoped")).select("dataset", "chrom", "i", "j", _r("corrected", 5))


_BLUR = f"""fc AS (SELECT DISTINCT chrom, bin2 AS b FROM c2),
nb AS (SELECT chrom, i, count(*) AS n FROM (SELECT chrom, unnest([b - 2, b - 1, b, b + 1, b + 2]) AS i FROM fc) WHERE i >= 0 AND i < {BINS} GROUP BY ALL),
sq AS (SELECT x.k AS a, y.k AS b FROM (SELECT unnest(range(-2, 3)) AS k) x, (SELECT unnest(range(-2, 3)) AS k) y),
bl AS (SELECT chrom, bin1 - a AS i, bin2 - b AS j, sum(v) AS s FROM c2, sq GROUP BY ALL),
bb AS (SELECT cel.chrom, cel.i, cel.j, CASE WHEN x.n * y.n > 0 THEN coalesce(s, 0) / (x.n * y.n) ELSE 0.0 END AS blur FROM cel LEFT JOIN bl USING (chrom, i, j)
  LEFT JOIN nb x ON x.chrom = cel.chrom AND x.i = cel.i LEFT JOIN nb y ON y.chrom = cel.chrom AND y.i = cel.j)"""


@query(f"WITH {C2}, {_CELLS}, {_BLUR} SELECT 'd' AS dataset, chrom, i, j, round(blur, 6) AS blur FROM bb")
def blurred_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map_cells(spark, sf_dir, "blur").select("dataset", "chrom", "i", "j", _r("blur"))


@query("""WITH p AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS k, l_linenumber * 1.5 AS mu FROM lineitem),
t AS (SELECT k, mu, unnest(range(0, k + 1)) AS i FROM p)
SELECT k, CAST(mu AS DOUBLE) AS mu, round(greatest(1 - sum(exp(-mu + i * ln(mu) - CASE WHEN i < 2 THEN 0 ELSE lgamma(i + 1) END)), 0), 6) AS p FROM t GROUP BY ALL""")
def poisson_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = li.select(F.col("l_quantity").cast("bigint").alias("k"), (F.col("l_linenumber") * 1.5).cast("double").alias("mu")).distinct()
    return rows.select("k", "mu", F.round(X.poisson_upper_tail("k", "mu"), 6).alias("p"))


@query(f"""WITH {C2}, {_DONUT}, {_BLUR}, f AS (SELECT oe.chrom, oe.i, oe.j, round(blur, 6) AS blur, CASE WHEN coalesce(hoped, 0) = 0 THEN NULL ELSE round(o * hoped / (e * seen + 1), 6) END AS p
  FROM oe JOIN dn USING (chrom, i, j) JOIN bb USING (chrom, i, j)),
a AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY blur, i, j) AS k, count(*) OVER (PARTITION BY chrom) AS n FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY p, i, j) AS r, count(*) OVER (PARTITION BY chrom) AS m FROM a WHERE k > floor(0.30000000000000004 * n) AND p IS NOT NULL)
SELECT 'd' AS dataset, chrom, i, j, blur, p FROM b WHERE r <= ceil(0.07142857142857144 * m)""")
def top_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both values are made and rounded in their tile: five columns of every cell, and a decimal for each value, would be most of the work."""
    stat = lambda c: np.where(c["hoped"] != 0, scores.rounded(c["o"] * c["hoped"] / (c["e"] * c["seen"] + 1), 6), np.nan)
    return scores.top_cells(_map_cells(spark, sf_dir, "o", "e", "seen", "hoped", "blur", blur=lambda c: scores.rounded(c["blur"], 6), p=stat))


@query(f"WITH {C2} SELECT 'd' AS dataset, chrom, bin1, bin2, v, (bin1 + bin2) / 2 AS px, CAST(bin2 - bin1 AS DOUBLE) AS py FROM c2")
def triangle_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.triangle_cells(views.pixels(spark, sf_dir))


@query(f"WITH {C2}, s AS (SELECT chrom, v FROM c2 UNION ALL SELECT chrom, v FROM c2 WHERE bin1 <> bin2) SELECT 'd' AS dataset, chrom, quantile_cont(v, 0.95) AS vmax FROM s GROUP BY chrom")
def color_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.color_limit(views.pixels(spark, sf_dir))


_LOOPS = f"(p_partkey * 200) {{div}} (SELECT max(p_partkey) + 1 FROM {{t}}) * {RES}"


@query(f"""WITH {C2}, lp AS (SELECT DISTINCT ['A', 'N', 'R'][p_partkey % 3 + 1] AS chrom, {_LOOPS.format(div='//', t='part')} AS s1, {_LOOPS.format(div='//', t='part')} + (5 + p_size % 20) * {RES} AS s2 FROM part),
o AS (SELECT unnest([-1, 0, 1]) AS k), cl AS (SELECT lp.*, s1 // {RES} + a.k AS x, s2 // {RES} + b.k AS y FROM lp, o a, o b),
h AS (SELECT cl.*, v, row_number() OVER (PARTITION BY cl.chrom, s1, s2 ORDER BY v DESC, x, y) AS r FROM cl JOIN c2 ON c2.chrom = cl.chrom AND bin1 = least(x, y) AND bin2 = greatest(x, y) WHERE x >= 0 AND y >= 0)
SELECT chrom, CAST(s1 AS BIGINT) AS start1, CAST(s1 + {RES} AS BIGINT) AS end1, CAST(s2 AS BIGINT) AS start2, CAST(s2 + {RES} AS BIGINT) AS end2, x AS bin1, y AS bin2, v FROM h WHERE r = 1""")
def loop_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = f"parquet.`{sf_dir}/part.parquet`"
    s1 = _LOOPS.format(div="div", t=t)
    loops = spark.sql(
        f"""SELECT DISTINCT element_at(array('A', 'N', 'R'), CAST(p_partkey % 3 + 1 AS INT)) AS chrom, CAST({s1} AS BIGINT) AS start1, CAST({s1} + {RES} AS BIGINT) AS end1,
        CAST({s1} + (5 + p_size % 20) * {RES} AS BIGINT) AS start2, CAST({s1} + (6 + p_size % 20) * {RES} AS BIGINT) AS end2 FROM {t}"""
    )
    return plotdata.snap_loops(loops, views.pixels(spark, sf_dir), RES)


@query("""SELECT DISTINCT CAST(o_custkey * 12347 AS BIGINT) AS pos, CASE WHEN o_custkey * 12347 // 1000000 = 0 THEN (o_custkey * 12347 % 1000000 // 1000) || 'K'
  WHEN o_custkey * 12347 % 1000000 // 1000 = 0 THEN (o_custkey * 12347 // 1000000) || 'M' ELSE (o_custkey * 12347 // 1000000) || 'M' || (o_custkey * 12347 % 1000000 // 1000) || 'K' END AS label FROM orders""")
def position_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") * 12347).cast("bigint").alias("pos")).distinct()
    return rows.select("pos", X.position_label("pos").alias("label"))


@query(f"WITH {C2} SELECT chrom, v, count(*) AS cells, CASE WHEN v <= 1 THEN 0.0 WHEN v >= 40 THEN 1.0 WHEN v <= 10 THEN (v - 1) / 9 * 0.5 ELSE (v - 10) / 30 * 0.5 + 0.5 END AS shade FROM c2 GROUP BY chrom, v")
def midpoint_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pixels(spark, sf_dir).groupBy("chrom", "v").agg(F.count("*").alias("cells"))
    return rows.select("chrom", "v", "cells", X.midpoint_normalize("v", 1, 40, 10).alias("shade"))
