"""Queries over interval sets, points and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.functions import expressions as X
from foldspark.operators import geometry, graph, intervals, scores
from foldspark.plans import plotdata
from foldspark.queries import query, views
from foldspark.queries.views import DA, DB, NEST

_OV = "CASE WHEN least({e1}, {e2}) <= greatest({s1}, {s2}) THEN 0.0 ELSE (least({e1}, {e2}) - greatest({s1}, {s2})) / (greatest({e1}, {e2}) - least({s1}, {s2})) END"


def _ov(s1: str, e1: str, s2: str, e2: str) -> str:
    return _OV.format(s1=s1, e1=e1, s2=s2, e2=e2)


@query(f"WITH {DA}, {DB} SELECT a.chrom, a.s AS start, a.e AS \"end\", b.s AS o_start, b.e AS o_end, round({_ov('a.s', 'a.e', 'b.s', 'b.e')}, 6) AS ratio FROM da a JOIN db b ON a.chrom = b.chrom AND a.e > b.s AND a.s < b.e")
def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (views.segments(spark, sf_dir, k).select("chrom", "start", "end") for k in (0, 1))
    both = intervals.overlapping(a, b, bucket=100)
    return both.select("chrom", "start", "end", "o_start", "o_end", F.round(X.overlap_ratio("start", "end", "o_start", "o_end"), 6).alias("ratio"))


@query(f"WITH {DA}, {DB} SELECT a.chrom, greatest(a.s, b.s) AS start, least(a.e, b.e) AS \"end\" FROM da a JOIN db b ON a.chrom = b.chrom AND a.e > b.s AND a.s < b.e")
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intersections(views.segments(spark, sf_dir, 0), views.segments(spark, sf_dir, 1), bucket=100)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.nested_levels(views.nested(spark, sf_dir), bucket=100)


_LEV = f"{NEST}, lev AS (SELECT x.chrom, x.s, x.e, count(*) - 1 AS level FROM nest x JOIN nest y ON x.chrom = y.chrom AND y.s <= x.s AND x.e <= y.e GROUP BY x.chrom, x.s, x.e)"


@query(f"WITH {_LEV} SELECT 'n' AS set_id, chrom, s AS start, e AS \"end\", level FROM lev")
def nested_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)


@query(f"WITH {_LEV}, p AS (SELECT chrom, s AS pos, level FROM lev WHERE e - s >= 5 UNION ALL SELECT chrom, e, level FROM lev WHERE e - s >= 5) SELECT 'n' AS set_id, chrom, pos, min(level) AS level FROM p GROUP BY chrom, pos")
def boundary_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.boundary_levels(_levels(spark, sf_dir), 1)


@query(f"""WITH {_LEV} SELECT 'n' AS set_id, o.chrom, o.s AS start, o.e AS "end", o.level, i.s AS c_start, i.e AS c_end, i.level AS c_level FROM lev o JOIN lev i
ON o.chrom = i.chrom AND i.s >= o.s AND i.e <= o.e AND i.level = o.level + 1""")
def nested_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.children(_levels(spark, sf_dir), bucket=100)


_LEAF = "leaf AS (SELECT * FROM lev o WHERE NOT EXISTS (SELECT 1 FROM lev i WHERE i.chrom = o.chrom AND i.s >= o.s AND i.e <= o.e AND i.level = o.level + 1))"


@query(f"""WITH {_LEV}, {_LEAF} SELECT 'n' AS set_id, i.chrom, i.s AS start, i.e AS "end", i.level, o.s AS root_start, o.e AS root_end FROM leaf i JOIN lev o
ON o.chrom = i.chrom AND i.s >= o.s AND i.e <= o.e AND o.level = 0""")
def leaf_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.leaf_roots(_levels(spark, sf_dir), bucket=100)


@query(f"""WITH {_LEV}, {_LEAF}, ch AS (SELECT leaf.chrom, leaf.s AS ls, leaf.e AS le, o.s, o.e, o.level, max(o.level) OVER (PARTITION BY leaf.chrom, leaf.s, leaf.e) AS deep
  FROM leaf JOIN lev o ON o.chrom = leaf.chrom AND leaf.s >= o.s AND leaf.e <= o.e WHERE o.s >= 800 AND o.e <= 2400)
SELECT DISTINCT 'n' AS set_id, chrom, s AS start, e AS "end", level FROM ch WHERE level = 2 OR (deep < 2 AND level = deep)""")
def region_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.region_domains(_levels(spark, sf_dir), 800, 2400, 2, bucket=100)


_BOUNDS = """{n}b0 AS (SELECT chrom, s AS pos FROM {d} WHERE e - s >= 5 UNION SELECT chrom, e FROM {d} WHERE e - s >= 5),
{n}b AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS idx FROM {n}b0)"""


def _near(name: str, points: str, bounds: str, tol: int = 5) -> str:
    """Nearest boundary and the range of neighbours of every point."""
    return f"""{name}x AS (SELECT p.chrom, p.pos, (SELECT max(idx) FROM {bounds} b WHERE b.chrom = p.chrom AND b.pos <= p.pos) AS l, (SELECT min(idx) FROM {bounds} b WHERE b.chrom = p.chrom AND b.pos >= p.pos) AS r,
  (SELECT min(idx) FROM {bounds} b WHERE b.chrom = p.chrom AND abs(b.pos - p.pos) < {tol}) AS lo, (SELECT max(idx) FROM {bounds} b WHERE b.chrom = p.chrom AND abs(b.pos - p.pos) < {tol}) AS hi,
  (SELECT count(*) FROM {bounds} b WHERE b.chrom = p.chrom) AS n FROM (SELECT DISTINCT chrom, pos FROM {points}) p),
{name}y AS (SELECT chrom, pos, coalesce(l, r) AS l, coalesce(r, l) AS r, lo, hi, n FROM {name}x WHERE n > 0),
{name} AS (SELECT y.chrom, y.pos, CASE WHEN abs(y.pos - br.pos) < abs(y.pos - bl.pos) THEN br.pos ELSE bl.pos END AS nearest,
  greatest(least(coalesce(lo, l), l) - 1, 0) AS first_idx, least(greatest(coalesce(hi, r), r) + 1, n - 1) AS last_idx
  FROM {name}y y JOIN {bounds} bl ON bl.chrom = y.chrom AND bl.idx = l JOIN {bounds} br ON br.chrom = y.chrom AND br.idx = r)"""


_AB = _BOUNDS.format(n="q", d="db")


@query(f"WITH {DA}, {DB}, {_AB}, pts AS (SELECT chrom, s AS pos FROM da UNION SELECT chrom, e FROM da), {_near('nr', 'pts', 'qb')} SELECT * FROM nr")
def nearest_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (views.segments(spark, sf_dir, k) for k in (0, 1))
    points = a.select("chrom", F.explode(F.array("start", "end")).alias("pos"))
    return intervals.nearest_boundaries(points, intervals.boundaries(b, 1), 5)


def _hits(name: str, t: str, bounds: str) -> str:
    return f"""{name}p AS (SELECT chrom, s AS pos FROM {t} UNION SELECT chrom, e FROM {t}), {_near(name + 'n', name + 'p', bounds)},
{name}c AS (SELECT d.chrom, d.s, d.e, i.pos AS hs, j.pos AS he, {_ov('d.s', 'd.e', 'i.pos', 'j.pos')} AS ratio FROM {t} d JOIN {name}n l ON l.chrom = d.chrom AND l.pos = d.s JOIN {name}n r ON r.chrom = d.chrom AND r.pos = d.e
  JOIN {bounds} i ON i.chrom = d.chrom AND i.idx >= l.first_idx JOIN {bounds} j ON j.chrom = d.chrom AND j.idx > i.idx AND j.idx <= r.last_idx),
{name} AS (SELECT * FROM {name}c WHERE ratio > 0 QUALIFY row_number() OVER (PARTITION BY chrom, s, e ORDER BY ratio DESC, hs DESC, he DESC) = 1)"""


@query(f"WITH {DA}, {DB}, {_AB}, {_hits('h', 'da', 'qb')} SELECT chrom, s AS start, e AS \"end\", hs AS hit_start, he AS hit_end, round(ratio, 6) AS ratio FROM h")
def best_overlap_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = intervals.best_spans(views.segments(spark, sf_dir, 0), views.segments(spark, sf_dir, 1), 1)
    return got.withColumn("ratio", F.round("ratio", 6))


_EDGES = f"""{DA}, {DB}, ta AS (SELECT * FROM da WHERE e - s >= 5), tb AS (SELECT * FROM db WHERE e - s >= 5), {_BOUNDS.format(n='q', d='db')}, {_BOUNDS.format(n='own', d='da')},
{_hits('h', 'ta', 'qb')}, {_hits('g', 'tb', 'ownb')},
f1 AS (SELECT h.chrom, h.s AS ts, h.e AS te, b.s AS qs, b.e AS qe FROM h JOIN tb b ON b.chrom = h.chrom AND b.s >= hs AND b.e <= he),
f2 AS (SELECT g.chrom, a.s AS ts, a.e AS te, g.s AS qs, g.e AS qe FROM g JOIN ta a ON a.chrom = g.chrom AND a.s >= hs AND a.e <= he),
ed AS (SELECT * FROM f1 INTERSECT SELECT * FROM f2)"""


@query(f"WITH {_EDGES} SELECT chrom, ts AS t_start, te AS t_end, qs AS q_start, qe AS q_end, round({_ov('ts', 'te', 'qs', 'qe')}, 6) AS ratio FROM ed")
def mutual_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = intervals.mutual_edges(views.segments(spark, sf_dir, 0), views.segments(spark, sf_dir, 1), 1)
    return got.withColumn("ratio", F.round("ratio", 6))


_PAIRS = f"""{_EDGES}, nd AS (SELECT chrom, 0 AS side, ts AS s, te AS e FROM ed UNION SELECT chrom, 1, qs, qe FROM ed),
ln AS (SELECT chrom, 0 AS side, ts AS s, te AS e, 1 AS side2, qs AS s2, qe AS e2 FROM ed UNION ALL SELECT chrom, 1, qs, qe, 0, ts, te FROM ed),
rc AS (SELECT chrom, side, s, e, side AS rs, s AS r0, e AS r1 FROM nd UNION SELECT rc.chrom, rc.side, rc.s, rc.e, side2, s2, e2 FROM rc JOIN ln ON ln.chrom = rc.chrom AND ln.side = rs AND ln.s = r0 AND ln.e = r1),
cp AS (SELECT chrom, side, s, e, min((rs, r0, r1)) AS k FROM rc GROUP BY ALL),
sp AS (SELECT chrom, k, min(s) FILTER (side = 0) AS ts, max(e) FILTER (side = 0) AS te, min(s) FILTER (side = 1) AS qs, max(e) FILTER (side = 1) AS qe FROM cp GROUP BY ALL),
pa AS (SELECT sp.chrom, ts, te, qs, qe, (SELECT count(*) FROM ta WHERE ta.chrom = sp.chrom AND ta.s >= ts AND ta.e <= te) AS nt, (SELECT count(*) FROM tb WHERE tb.chrom = sp.chrom AND tb.s >= qs AND tb.e <= qe) AS nq FROM sp)"""
_PAIR_COLUMNS = "chrom, ts AS t_start, te AS t_end, qs AS q_start, qe AS q_end, nt AS n_target, nq AS n_query"


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, b = (views.segments(spark, sf_dir, k) for k in (0, 1))
    return intervals.region_pairs(a, b, 1), a, b


@query(f"WITH RECURSIVE {_PAIRS} SELECT {_PAIR_COLUMNS} FROM pa")
def region_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)[0]


@query(f"WITH RECURSIVE {_PAIRS} SELECT {_PAIR_COLUMNS} FROM pa WHERE nt = 1 AND nq = 1")
def conserved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.pair_classes(_pairs(spark, sf_dir)[0]).where("class = 'conserved'").drop("class")


@query(f"WITH RECURSIVE {_PAIRS} SELECT {_PAIR_COLUMNS} FROM pa WHERE nt > 1 AND nq = 1")
def merged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.pair_classes(_pairs(spark, sf_dir)[0]).where("class = 'merged'").drop("class")


@query(f"WITH RECURSIVE {_PAIRS} SELECT chrom, qs AS t_start, qe AS t_end, ts AS q_start, te AS q_end, nq AS n_target, nt AS n_query FROM pa WHERE nt = 1 AND nq > 1")
def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen from the other set, where they are merged."""
    return intervals.swap_pairs(intervals.pair_classes(_pairs(spark, sf_dir)[0]).where("class = 'split'").drop("class"))


def _level_sql(name: str, segments: str) -> str:
    """Boundaries with 0 where a block of segments (by 120 positions) begins or ends, else 1."""
    wide = f"SELECT chrom, min(s) AS s, max(e) AS e FROM {segments} GROUP BY chrom, s // 120"
    ends = lambda t, level: f"SELECT chrom, unnest([s, e]) AS pos, {level} AS level FROM ({t}) WHERE e - s >= 5"
    return f"{name} AS (SELECT chrom, pos, min(level) AS level FROM ({ends(f'SELECT * FROM {segments}', 1)} UNION ALL {ends(wide, 0)}) GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {_PAIRS}, en AS (SELECT chrom, ts AS pos, qs AS qp, ts, te FROM pa UNION ALL SELECT chrom, te, qe, ts, te FROM pa),
kp AS (SELECT chrom, pos, qp FROM en QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY ts DESC, te DESC) = 1), {_level_sql('tl', 'da')}, {_level_sql('ql', 'db')}
SELECT kp.chrom, CASE WHEN tl.level = 0 AND ql.level = 0 THEN 'conserved_tad' WHEN tl.level = 0 THEN 'tad_to_sub' WHEN ql.level = 0 THEN 'sub_to_tad' ELSE 'conserved_sub' END AS class, kp.pos, qp AS q_pos
FROM kp JOIN tl ON tl.chrom = kp.chrom AND tl.pos = kp.pos JOIN ql ON ql.chrom = kp.chrom AND ql.pos = qp
UNION ALL SELECT chrom, CASE WHEN level = 0 THEN 'disappeared_tad' ELSE 'disappeared_sub' END, pos, NULL FROM tl WHERE NOT EXISTS (SELECT 1 FROM kp WHERE kp.chrom = tl.chrom AND kp.pos = tl.pos)""")
def boundary_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six classes: regions of single-level segments, boundaries of hierarchies with blocks of segments around them."""
    p = _pairs(spark, sf_dir)[0]
    return intervals.boundary_classes(p, *(views.hierarchy(spark, sf_dir, k) for k in (0, 1)), 1)


@query("""WITH RECURSIVE v AS (SELECT c_custkey AS id FROM customer),
e AS (SELECT * FROM (SELECT c_custkey AS a, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey) AS b FROM customer) WHERE b IS NOT NULL),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT id, id AS x FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.x)
SELECT CAST(id AS BIGINT) AS id, CAST(min(x) AS BIGINT) AS comp FROM r GROUP BY id""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation and segment, each linked with the next by balance."""
    e = spark.sql(
        f"""SELECT CAST(c_custkey AS BIGINT) AS a, CAST(lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey) AS BIGINT) AS b
        FROM parquet.`{sf_dir}/customer.parquet`"""
    )
    return graph.connected_components(e.select(F.col("a").alias("id")), e.where("b is not null"))


@query(f"""WITH {DA}, dk AS (SELECT * FROM da WHERE s % 4 <> 0), bo AS (SELECT chrom, s AS pos FROM dk WHERE e - s >= 5 UNION SELECT chrom, e FROM dk WHERE e - s >= 5),
h AS (SELECT chrom, pos AS s, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS e FROM bo),
g AS (SELECT h.chrom, s, e, (SELECT avg(CASE WHEN p % 5 = 0 AND p < 500 OR p > 900 THEN 1.0 ELSE 0.0 END) FROM (SELECT unnest(range(s, e)) AS p)) AS share FROM h WHERE e - s >= 3),
n AS (SELECT chrom, s, e FROM dk UNION SELECT chrom, s, e FROM g WHERE share < 0.2)
SELECT '0' AS set_id, x.chrom, x.s AS start, x.e AS "end", count(*) - 1 AS level FROM n x JOIN n y ON x.chrom = y.chrom AND y.s <= x.s AND x.e <= y.e GROUP BY x.chrom, x.s, x.e""")
def hole_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.segments(spark, sf_dir, 0).where("start % 4 <> 0")
    return intervals.fill_holes(d, _positions(d).where("(pos % 5 = 0 and pos < 500) or pos > 900"), 1, bucket=100)


def _positions(domains: DataFrame) -> DataFrame:
    """(chrom, pos): all positions up to the last end of each chromosome."""
    return domains.groupBy("chrom").agg(F.max("end").alias("last")).select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("pos"))


_PTS = "pts AS (SELECT user_id % 20 AS g, CAST(event_id AS BIGINT) AS id, CAST(event_id * 37 % 101 AS BIGINT) AS x, CAST(event_id * 53 % 97 AS BIGINT) AS y FROM events)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select((F.col("user_id") % 20).alias("g"), F.col("event_id").cast("bigint").alias("id"), (F.col("event_id") * 37 % 101).cast("bigint").alias("x"), (F.col("event_id") * 53 % 97).cast("bigint").alias("y"))


_PAR = f"{_PTS}, par AS (SELECT g, count(*) AS n, CAST(ceil(count(*) / 25) + 1 AS BIGINT) AS k, sqrt((max(x) - min(x)) * (max(y) - min(y)) * (ceil(count(*) / 25) + 1) / (count(*) * pi())) AS eps FROM pts GROUP BY g)"


@query(f"WITH {_PAR} SELECT g, n AS n_points, k AS min_points, round(eps, 6) AS eps FROM par")
def dbscan_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.cluster_parameters(_points(spark, sf_dir), ["g"]).withColumn("eps", F.round("eps", 6))


@query(f"""WITH {_PAR} SELECT a.g, a.id, a.x, a.y, count(*) AS near, count(*) >= any_value(k) AS core FROM pts a JOIN pts b ON a.g = b.g JOIN par ON par.g = a.g
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= greatest(eps, sqrt(2)) * greatest(eps, sqrt(2)) GROUP BY a.g, a.id, a.x, a.y""")
def dbscan_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return scores.core_points(p, scores.cluster_parameters(p, ["g"]), ["g"])


@query("""WITH p AS (SELECT o_orderkey AS k, list({'x': l_linenumber * 3, 'y': l_quantity} ORDER BY l_linenumber, l_quantity) AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) >= 3),
i AS (SELECT k, p, unnest(range(1, len(p) + 1)) AS i FROM p)
SELECT k, round(CAST(abs(sum(p[i].x * p[i % len(p) + 1].y - p[i % len(p) + 1].x * p[i].y)) / 2 AS DOUBLE), 6) AS area FROM i GROUP BY k""")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("y"))))
    rings = li.groupBy(F.col("l_orderkey").alias("k")).agg(p.alias("p")).where("size(p) >= 3")
    rings = rings.select("k", F.transform("p", lambda q: F.struct((q["n"] * 3).cast("double").alias("x"), q["y"].alias("y"))).alias("points"))
    return geometry.polygon_areas(rings).select("k", F.round("area", 6).alias("area"))


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS x, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber * 2 + 1 ELSE CAST(l_quantity AS BIGINT) END AS y FROM lineitem),
w AS (SELECT k, x, y, lag(x, 2) OVER o AS x0, lag(y, 2) OVER o AS y0, lag(x) OVER o AS x1, lag(y) OVER o AS y1 FROM p WINDOW o AS (PARTITION BY k ORDER BY x, y))
SELECT k, coalesce(bool_and(x0 * y1 - x1 * y0 + x1 * y - x * y1 + x * y0 - x0 * y = 0), true) AS collinear FROM w GROUP BY k""")
def collinear_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    y = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_linenumber").cast("bigint") * 2 + 1).otherwise(F.col("l_quantity").cast("bigint"))
    return geometry.collinear_groups(li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("x"), y.alias("y")), ["k"])


@query(f"WITH {_PTS} SELECT g, id, x, y, (60 * (y - 10) - 5 * (x - 10) >= 0 AND 10 * (y - 15) - 60 * (x - 70) >= 0 AND -55 * (y - 75) - 5 * (x - 80) >= 0 AND -15 * (y - 80) + 70 * (x - 25) >= 0) AS inside FROM pts")
def point_in_convex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.points_in_convex(_points(spark, sf_dir), _RING)


@query(f"""WITH {DA} SELECT chrom, s AS start, e AS "end", (greatest(s, 200) - 200) // 4 AS x1, ((greatest(s, 200) - 200) // 4 + (least(e, 900) - 200) // 4) / 2 AS x2, (least(e, 900) - 200) // 4 AS x3,
CAST((least(e, 900) - 200) // 4 - (greatest(s, 200) - 200) // 4 AS DOUBLE) AS y2 FROM da WHERE chrom = 'BUILDING' AND e > 200 AND s < 900 AND (least(e, 900) - 200) // 4 - (greatest(s, 200) - 200) // 4 >= 2""")
def tad_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.triangle_outlines(views.segments(spark, sf_dir, 0), "BUILDING", 200, 900, 4)


@query("""SELECT DISTINCT CASE WHEN starts_with(c, 'chr') THEN c[4:] ELSE c END AS bare, 'chr' || CASE WHEN starts_with(c, 'chr') THEN c[4:] ELSE c END AS full FROM (
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'chr' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN 'hrc' ELSE '' END || c_custkey % 23 AS c FROM customer)""")
def chrom_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.sql(f"SELECT concat(CASE WHEN c_custkey % 2 = 0 THEN 'chr' ELSE '' END, CASE WHEN c_custkey % 5 = 0 THEN 'hrc' ELSE '' END, c_custkey % 23) AS c FROM parquet.`{sf_dir}/customer.parquet`")
    return c.select(X.strip_prefix("c").alias("bare"), X.force_prefix("c").alias("full")).distinct()


@query(f"""WITH {_LEV}, b AS (SELECT chrom, s AS pos, level FROM lev WHERE e - s >= 5 UNION ALL SELECT chrom, e, level FROM lev WHERE e - s >= 5), m AS (SELECT chrom, pos, min(level) AS lv FROM b GROUP BY 1, 2),
l AS (SELECT chrom, pos // 50 AS blk, list(lv ORDER BY pos) AS lv FROM m GROUP BY 1, 2)
SELECT chrom, blk, CASE WHEN len(lv) <= 2 THEN true ELSE list_min(lv[2:len(lv) - 1]) >= greatest(lv[1], lv[len(lv)]) END AS ok FROM l""")
def levels_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = intervals.boundary_levels(_levels(spark, sf_dir), 1)
    lv = F.transform(F.sort_array(F.collect_list(F.struct("pos", "level"))), lambda x: x["level"])
    return b.groupBy("chrom", F.floor(F.col("pos") / 50).alias("blk")).agg(lv.alias("lv")).select("chrom", "blk", X.levels_compatible("lv").alias("ok"))


@query(f"WITH {DA} SELECT chrom, s AS start, e AS \"end\" FROM da WHERE e - s >= 8")
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.at_least(views.segments(spark, sf_dir, 0), 4, 2).select("chrom", "start", "end")


@query(f"WITH {DA} SELECT chrom, s AS start, e AS \"end\", (s % 10) / 10 AS noise FROM da WHERE (s % 10) / 10 <= 0.5")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.segments(spark, sf_dir, 0).select("chrom", "start", "end", (F.col("start") % 10 / 10).alias("noise"))
    return intervals.noise_filter(rows, 0.5)


@query(f"WITH {NEST} SELECT x.chrom, x.s AS start, x.e AS \"end\", count(*) AS inner_intervals FROM nest x JOIN nest y ON x.chrom = y.chrom AND y.s >= x.s AND y.e <= x.e GROUP BY ALL")
def contained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.nested(spark, sf_dir).distinct()
    got = intervals.contained(d, d, bucket=100)
    return got.groupBy("chrom", F.col("o_start").alias("start"), F.col("o_end").alias("end")).agg(F.count("*").alias("inner_intervals"))


@query(f"WITH {DA} SELECT chrom, s AS start, e AS \"end\" FROM da WHERE chrom = 'BUILDING' AND e > 300 AND s < 700")
def overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlaps_window(views.segments(spark, sf_dir, 0), "BUILDING", 300, 700).select("chrom", "start", "end")


@query(f"""WITH {DA} SELECT chrom, s AS start, e AS "end", (SELECT avg(CASE WHEN p % 3 = 0 OR p % 5 = 0 THEN 1.0 ELSE 0.0 END) FROM (SELECT unnest(range(s, e)) AS p)) AS gap_share FROM da""")
def gap_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the gap bins of either of two replicates."""
    d = views.segments(spark, sf_dir, 0)
    reps = [_positions(d).where(f"pos % {k} = 0") for k in (3, 5)]
    return intervals.gap_share(d, reps[0].union(reps[1]).distinct(), 1)


@query("""SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS obs, CAST(l_linenumber % 4 AS DOUBLE) AS expected, CASE WHEN l_linenumber % 4 = 0 THEN 0.0 ELSE round(l_quantity / (l_linenumber % 4), 6) END AS fold FROM lineitem""")
def fold_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("obs"), (F.col("l_linenumber") % 4).cast("double").alias("expected")).distinct()
    return li.select("obs", "expected", F.round(X.fold_enrichment("obs", "expected"), 6).alias("fold"))


@query("""WITH t AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_partkey || '.5' WHEN 1 THEN p_name WHEN 2 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS t FROM part) SELECT t, TRY_CAST(t AS DOUBLE) IS NOT NULL AS number FROM t""")
def is_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(f"SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN concat(p_partkey, '.5') WHEN 1 THEN p_name WHEN 2 THEN CAST(p_partkey AS STRING) ELSE '' END AS t FROM parquet.`{sf_dir}/part.parquet`")
    return t.select("t", X.is_number("t").alias("number"))


_CLU = f"{_PTS}, cl AS (SELECT *, CASE WHEN id % 5 = 0 THEN -1 ELSE id % 91 END AS c FROM pts)"


@query(f"""WITH {_CLU}, s AS (SELECT *, count(*) OVER (PARTITION BY g, c) AS n FROM cl), k AS (SELECT * FROM s WHERE c = -1 OR n > 1)
SELECT g, id, CAST(CASE WHEN c = -1 THEN -1 ELSE dense_rank() OVER (PARTITION BY g, c = -1 ORDER BY c) - 1 END AS INT) AS cluster FROM k""")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).withColumn("cluster", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("id") % 91))
    return scores.drop_lone_clusters(p, ["g"]).select("g", "id", F.col("cluster").cast("int").alias("cluster"))


@query(f"""WITH {_CLU}, c AS (SELECT g, c, count(*) AS size, 1.0 / (1 + c) AS density, CAST(max(x) - min(x) AS DOUBLE) AS area, 500 AS cells FROM cl WHERE c >= 0 GROUP BY g, c)
SELECT g, round(sum(density * size) / sum(size), 6) AS density, round(sum(area) / max(cells), 6) AS cover FROM c GROUP BY g""")
def cluster_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).where("id % 5 <> 0").withColumn("c", F.col("id") % 91)
    c = p.groupBy("g", "c").agg(F.count("*").alias("size"), (F.max("x") - F.min("x")).cast("double").alias("area")).withColumns({"density": 1 / (1 + F.col("c")), "cells": F.lit(500)})
    return scores.weighted_density(c, ["g"]).select("g", F.round("density", 6).alias("density"), F.round("cover", 6).alias("cover"))


_RING = [(10, 10), (70, 15), (80, 75), (25, 80)]


def _distance_sql() -> str:
    sides, far = [], []
    for (ax, ay), (bx, by) in zip(_RING, [*_RING[1:], _RING[0]], strict=True):
        dx, dy = bx - ax, by - ay
        t = f"greatest(0.0, least(1.0, ((x - {ax}) * {dx} + (y - {ay}) * {dy}) / {float(dx * dx + dy * dy)}))"
        sides.append(f"(y - {ay}) * {dx} - (x - {ax}) * {dy} >= 0")
        far.append(f"pow(x - {ax} - {dx} * {t}, 2) + pow(y - {ay} - {dy} * {t}, 2)")
    return f"WITH {_PTS} SELECT g, id, round(CASE WHEN {' AND '.join(sides)} THEN 1 ELSE -1 END * sqrt(least({', '.join(far)})), 6) + 0.0 AS distance FROM pts"


@query(_distance_sql())
def polygon_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed distances to a convex outline."""
    return geometry.distances_to_convex(_points(spark, sf_dir), _RING).select("g", "id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"""WITH {_PTS}, u AS (SELECT DISTINCT g, x, y FROM (SELECT g, x, min(y) AS y FROM pts GROUP BY 1, 2 UNION ALL SELECT g, x, max(y) FROM pts GROUP BY 1, 2)),
ed AS (SELECT a.g, a.x AS ax, a.y AS ay, b.x AS cx, b.y AS cy FROM u a JOIN u b ON a.g = b.g AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.g = a.g AND ((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) < 0
    OR (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) = 0 AND ((p.x - a.x) * (p.x - b.x) + (p.y - a.y) * (p.y - b.y) > 0))))
SELECT g, count(*) AS n_vertices, round(CAST(sum(ax * cy - cx * ay) AS DOUBLE) / 2, 6) AS area FROM ed GROUP BY g""")
def hull_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex hulls of groups of points; SQL looks for the pairs that have all other points on their left."""
    return geometry.hull_shapes(_points(spark, sf_dir), ["g"]).withColumn("area", F.round("area", 6))


@query()
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of points; held against plain loops in the tests."""
    p = _points(spark, sf_dir)
    return scores.dbscan_labels(p, scores.cluster_parameters(p, ["g"]), ["g"])


@query(f"""WITH {_CLU}, m AS (SELECT g, id, x, y, c, id % 2 = 0 AS core, 6 AS k FROM cl WHERE c >= 0),
pr AS (SELECT a.g, a.c, a.id, a.k, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, b.id AS id2 FROM m a JOIN m b ON a.g = b.g AND a.c = b.c AND a.id <> b.id WHERE a.core),
nr AS (SELECT g, c, id, k, sum(d) AS s FROM (SELECT *, row_number() OVER (PARTITION BY g, c, id ORDER BY d, id2) AS r FROM pr) WHERE r < k GROUP BY ALL),
rd AS (SELECT g, c, avg(s / (k - 1)) AS radius, avg((k - 1) / nullif(s, 0)) AS density FROM nr GROUP BY ALL), sz AS (SELECT g, c, count(*) AS size FROM m GROUP BY ALL)
SELECT g, c AS cluster, size, round(radius, 6) AS radius, round(density, 6) AS density FROM sz LEFT JOIN rd USING (g, c)""")
def cluster_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius and density of labelled points, with fixed labels and core points."""
    p = _points(spark, sf_dir).withColumns({"cluster": F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("id") % 91), "core": F.col("id") % 2 == 0, "min_points": F.lit(6)})
    return scores.cluster_radii(p, ["g"]).select("g", "cluster", "size", F.round("radius", 6).alias("radius"), F.round("density", 6).alias("density"))
