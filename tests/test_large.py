"""Work that must not grow with the square of a table, or with a path's length: larger inputs than the other tests, against plain loops."""

import random
import time
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldspark.operators import graph, hierarchy, intervals, matrix, scores


@pytest.mark.parametrize("together, kind", [(2_000_000, "bigint"), (500, "string")])
def test_components_of_long_paths(spark, together, kind):
    """Paths of 3,000 nodes with ids in disorder, of which a spread of labels needs more than 200 rounds; a ring, a pair, and nodes without an edge."""
    draw = random.Random(7)
    ids = draw.sample(range(10**6), 6_020)
    paths = [ids[:3_000], ids[3_000:6_000], [*ids[6_000:6_010], ids[6_000]], ids[6_010:6_012]]
    edges = [(a, b) for p in paths for a, b in zip(p, p[1:], strict=False)] + [(ids[6_012], ids[6_012]), (ids[1], ids[0])]
    name = (lambda c: f"{c}") if kind == "bigint" else (lambda c: f"lpad({c}, 7, '0') AS {c}")
    vertices = spark.createDataFrame([(x,) for x in ids], "id bigint").selectExpr(name("id"))
    links = spark.createDataFrame(edges, "a bigint, b bigint").selectExpr(name("a"), name("b"))
    got = {int(r["id"]): int(r["comp"]) for r in graph.connected_components(vertices, links, together=together).collect()}
    assert got == {x: x for x in ids} | {x: min(p) for p in paths for x in p}


def test_components_without_edges(spark):
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert sorted(tuple(r) for r in graph.connected_components(spark.range(3), none).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_nearest_boundaries_in_running_frames(spark):
    """No frame up to the last row, which is gone through again for every row; 20,000 points against bisection."""
    draw = random.Random(3)
    bounds = sorted(draw.sample(range(200_000), 12_000))
    points = draw.sample(range(-50, 200_050), 20_000)
    table = spark.createDataFrame([("c", p, k) for k, p in enumerate(bounds)], "chrom string, pos bigint, idx bigint")
    df = intervals.nearest_boundaries(spark.createDataFrame([("c", p) for p in points], "chrom string, pos bigint"), table, 5)
    assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
    got = {r["pos"]: (r["nearest"], r["first_idx"], r["last_idx"]) for r in df.collect()}
    assert len(got) == len(points)
    for p in points:
        left, right = bisect_right(bounds, p) - 1, bisect_left(bounds, p)
        left, right = (left if left >= 0 else right), (right if right < len(bounds) else left)
        nearest = bounds[right] if abs(bounds[right] - p) < abs(bounds[left] - p) else bounds[left]
        first, last = min(bisect_right(bounds, p - 5), left), max(bisect_left(bounds, p + 5) - 1, right)
        assert got[p] == (nearest, max(first - 1, 0), min(last + 1, len(bounds) - 1))


def test_stencils_over_tiles(spark):
    """Each cell is sent to the tiles it reaches and not to every column around it; sums across the borders of tiles, on 300 bins, against whole arrays."""
    draw, n = np.random.default_rng(5), 300
    at = np.array([(i, j) for i, j in zip(*np.triu_indices(n, 5), strict=True) if abs(i - 256) < 9 or abs(j - 256) < 9 or j - i < 7])
    o, e = draw.integers(0, 5, len(at)).astype(float), draw.random(len(at))
    cells = spark.createDataFrame([("d", "c", int(i), int(j), float(a), float(b)) for (i, j), a, b in zip(at, o, e, strict=True)], "dataset string, chrom string, i bigint, j bigint, o double, e double")
    pad = np.zeros((2, n + 10, n + 10))
    pad[:, at[:, 0] + 5, at[:, 1] + 5] = o, e
    near = [(a, b) for a in range(-5, 6) for b in range(-5, 6)]
    sums = lambda offsets: sum(pad[:, 5 + a : 5 + a + n, 5 + b : 5 + b + n] for a, b in offsets)
    want = sums([(a, b) for a, b in near if a and b and (abs(a) > 2 or abs(b) > 2)])
    for sources in (cells, cells.select("*")):
        df = scores.donut(cells, sources)
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
        got = df.collect()
        assert len(got) == len(at)
        for r in got:
            assert [r["seen"], r["hoped"]] == pytest.approx(want[:, r["i"], r["j"]], abs=1e-9)
    pixels = cells.where("o > 0").selectExpr("dataset", "chrom", "i AS bin1", "j AS bin2", "o AS v")
    df = scores.blurred(cells, pixels, spark.createDataFrame([("d", "c", n)], "dataset string, chrom string, n bigint"))
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    full = np.zeros(n + 4)
    full[at[o > 0, 1] + 2] = 1
    count = sum(full[k : k + n] for k in range(5))
    count = np.outer(count, count)
    want = np.where(count > 0, sums([(a, b) for a, b in near if abs(a) <= 2 and abs(b) <= 2])[0] / np.maximum(count, 1), 0)
    got = df.collect()
    assert len(got) == len(at)
    for r in got:
        assert r["blur"] == pytest.approx(want[r["i"], r["j"]], abs=1e-9)


def test_alignment_of_long_chromosomes():
    """Two hierarchies of 10,000 domains and their blocks: once through all domains for each would take minutes. Levels, inner domains and outermost ones against plain loops on a smaller set."""
    draw = random.Random(11)
    ends = [sorted(draw.sample(range(120_000), 10_000)) for _ in range(2)]
    began = time.process_time()
    sets = []
    for e in ends:
        spans = list(zip(e, e[1:], strict=False))
        blocks = defaultdict(list)
        for s in spans:
            blocks[s[0] // 120].append(s)
        sets.append(hierarchy.DomainSet(hierarchy.levels(spans + [(b[0][0], b[-1][1]) for b in blocks.values()]), 1))
    there, back = hierarchy.align(*sets)
    rows = hierarchy.boundary_classes(there, *sets)
    assert there.outer and there.inner and {t for _, t, _ in rows} == set(sets[0].bounds)
    assert hierarchy.inner_changed(there, back, *sets) <= set(there.outer)
    assert time.process_time() - began < 30
    spans = sorted({(s, s + draw.randrange(0, 90)) for s in (draw.randrange(400) for _ in range(150))})
    rows = hierarchy.levels(spans)
    assert rows == [(s, e, sum(a <= s and e <= b for a, b in spans) - 1) for s, e in spans]
    d = hierarchy.DomainSet(rows, 1)
    assert all(d.inner[x] == [y for y in d.domains if y[0] >= x[0] and y[1] <= x[1]] for x in d.domains)
    plain = lambda s, e, nodes: {k: v for x in nodes if x[0] < e and x[1] > s for k, v in ({x[:2]: x[2]} if x[0] >= s and x[1] <= e else plain(s, e, d.children[x])).items()}
    assert all(d.maximal(s, s + w) == plain(s, s + w, d.roots) for s in range(-5, 420, 7) for w in (3, 40, 150))


def test_radii_without_all_pairs(spark):
    """One cluster of 100,000 points, with copies of a position and few members elsewhere: all pairs would be 10^10. Distances against loops on a part."""
    draw = np.random.default_rng(2)
    x, y = draw.integers(0, 400, (2, 100_000))
    x[:5_000] = y[:5_000] = 7
    rows = spark.createDataFrame(pd.DataFrame({"g": 0, "id": np.arange(len(x)), "x": x, "y": y, "core": True, "cluster": 0, "min_points": 6}))
    got = scores.cluster_radii(rows, ["g"])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    (r,) = got.collect()
    place, n = np.unique(np.stack((x, y)), axis=1, return_counts=True)
    d = scores.near_distances(place[0], place[1], n, np.arange(len(n)), 5)
    assert r["size"] == len(x) and r["radius"] == pytest.approx((d.sum(axis=1) * n).sum() / len(x) / 5, abs=1e-9)
    for p in draw.integers(0, len(n), 40).tolist():
        far = np.sort(np.hypot(x - place[0, p], y - place[1, p]))[1:6]
        assert d[p] == pytest.approx(far, abs=1e-9)
    few = scores.near_distances(np.array([0.0, 3.0]), np.array([0.0, 4.0]), np.array([2, 1]), np.array([0, 1]), 4)
    assert few.tolist() == [[0, 5, np.inf, np.inf], [5, 5, np.inf, np.inf]]


def test_cells_are_made_in_tiles(spark):
    """Cells of whole maps are no rows before they are results: what goes to the tiles is a pixel or one row a tile. 300 bins, and a map of one tile, against the steps on cells as rows."""
    draw, ends = np.random.default_rng(9), {"c": 300, "s": 40}
    put = [(c, int(i), int(j), float(draw.integers(1, 9))) for c, n in ends.items() for i, j in zip(*np.triu_indices(n), strict=True) if draw.random() < 0.03]
    pixels = spark.createDataFrame([("d", *x) for x in put], "dataset string, chrom string, bin1 bigint, bin2 bigint, v double")
    sizes = spark.createDataFrame([("d", c, n) for c, n in (*ends.items(), ("empty", 7))], "dataset string, chrom string, n bigint")
    decay = matrix.distance_decay(pixels, sizes)
    df = scores.every_cell(pixels, sizes, decay, ["o", "e", "seen", "hoped", "blur"])
    got = {(r["chrom"], r["i"], r["j"]): [r[c] for c in ("o", "e", "seen", "hoped", "blur")] for r in df.collect()}
    mean = {(r["chrom"], r["d"]): r["mean_v"] for r in decay.collect()}
    value = {x[:3]: x[3] for x in put}
    cells = [("d", c, i, j, value.get((c, i, j), 0.0), mean[c, j - i]) for c, n in (*ends.items(), ("empty", 7)) for i in range(n) for j in range(i + 5, n)]
    table = spark.createDataFrame(pd.DataFrame(cells, columns=["dataset", "chrom", "i", "j", "o", "e"]))
    want = scores.blurred(scores.donut(table, table), pixels, sizes).toPandas()
    assert len(got) == len(cells) == len(want)
    for _, c, i, j, *rest in want[["dataset", "chrom", "i", "j", "o", "e", "seen", "hoped", "blur"]].itertuples(index=False):
        assert got[c, i, j] == pytest.approx(rest, abs=1e-9)


def test_cells_get_lists_apart_from_pixels(spark, sf):
    """With each row of a batch Spark goes through all lists of the batch: pixels and the lists of a tile are two tables. No more leaves a tile than is ranked, rounded as Spark does."""
    from foldspark.queries import maps, queries

    df = queries()["top_cells"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "FlatMapCoGroupsInArrow" in plan and "hoped" not in plan and "round(" not in plan
    full = maps._map_cells(spark, sf, "o", "e", "seen", "hoped", "blur")
    stat = F.when(F.col("hoped") != 0, F.round(F.col("o") * F.col("hoped") / (F.col("e") * F.col("seen") + 1), 6))
    want = scores.top_cells(full.select("dataset", "chrom", "i", "j", F.round("blur", 6).alias("blur"), stat.alias("p")))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect())) and df.count() > 100
    gone = scores.every_cell(
        spark.createDataFrame([("d", "c", 3, 9, 2.0)], "dataset string, chrom string, bin1 bigint, bin2 bigint, v double"),
        spark.createDataFrame([("d", "c", 12)], "dataset string, chrom string, n bigint"),
        spark.range(12).selectExpr("'d' AS dataset", "'c' AS chrom", "id AS d", "1.0D AS mean_v"),
        ["o"],
        made={"q": lambda c: np.where(c["o"] > 0, c["o"] / 3, np.nan)},
    ).collect()
    assert {(r["i"], r["j"], r["q"]) for r in gone} == {(i, j, 2 / 3 if (i, j) == (3, 9) else None) for i in range(12) for j in range(i + 5, 12)}


def test_rounding_of_doubles_as_in_spark(spark):
    """Halves, values near them, large ones, no numbers."""
    draw = np.random.default_rng(1)
    halves = (draw.integers(0, 10**9, 2_000) * 2 + 1) / 2e6
    x = np.concatenate((halves, np.nextafter(halves, 0), np.nextafter(halves, 9e9), draw.random(2_000) * 10.0 ** draw.integers(-9, 18, 2_000), [0.0, 1e300, 5e-324, 2.5e-6, 4503599627.3704955, np.inf, np.nan]))
    x = np.concatenate((x, -x))
    want = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(x)), "x": x})).select("k", (F.round("x", 6) + 0.0).alias("y"), (F.round("x", 2) + 0.0).alias("z")).orderBy("k").toPandas()
    for digits, name in ((6, "y"), (2, "z")):
        got = scores.rounded(x, digits)
        assert np.array_equal(got, want[name].to_numpy(), equal_nan=True) and not np.signbit(got[got == 0]).any()


def test_calls_make_pixels_once(spark, tmp_path):
    """What the windows, the training values and the calls read is one table of pixels."""
    from foldspark.plans.pipeline import Genome

    draw = np.random.default_rng(6)
    put = [("d", "c", int(i), int(j), float(1 + draw.poisson(40 / (1 + j - i)) * (3 if i // 20 == j // 20 else 1))) for i, j in zip(*np.triu_indices(120), strict=True) if j - i < 60]
    seen = spark.sparkContext.accumulator(0)
    spark.createDataFrame(put, "dataset string, chrom string, bin1 bigint, bin2 bigint, v double").write.parquet(f"{tmp_path}/px")
    count = lambda batches: (seen.add(b.num_rows) or b for b in batches)
    px = spark.read.parquet(f"{tmp_path}/px").mapInArrow(count, "dataset string, chrom string, bin1 bigint, bin2 bigint, v double")
    bins = spark.range(120).selectExpr("'d' AS dataset", "'c' AS chrom", "id AS bin", "id * 40000 AS start", "(id + 1) * 40000 AS end")
    g = Genome(px, bins, 40_000)
    g.learning(5)
    g.call_domains().collect()
    assert seen.value == len(put)
    g.wipe()
    assert g.cells is None


def _spread(draw: random.Random, n: int, wide: int, most: int) -> list[tuple[int, int]]:
    return [(s, s + draw.randrange(0, most)) for s in (draw.randrange(wide) for _ in range(n))]


def _best(d: tuple[int, int], bounds: list[int]) -> tuple[float, int, int]:
    """By plain loops over all stretches."""
    ratio = lambda s, e: max(0, min(d[1], e) - max(d[0], s)) / max(1, max(d[1], e) - min(d[0], s))
    return max(((ratio(s, e), s, e) for i, s in enumerate(bounds) for e in bounds[i + 1 :]), default=(0.0, 0, 0))


def test_best_spans_of_domains_with_many_bounds(spark):
    """Domains that hold 10,000 bounds: no row for every bound or stretch. On few bounds against all stretches; with copies, gaps, nulls, and chromosomes of one set only."""
    draw = random.Random(4)
    schema = "chrom string, start bigint, end bigint"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    bounds = sorted(draw.sample(range(0, 200_000, 5), 10_000))
    long = [(bounds[k] - 2, bounds[-1 - k] + 1) for k in range(50)]
    df = intervals.best_spans(frame([("c", *d) for d in long]), frame([("c", *x) for x in zip(bounds, bounds[1:], strict=False)]), 1)
    assert "Generate" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Window" not in plan
    assert {(r["start"], r["end"]): (r["hit_start"], r["hit_end"]) for r in df.collect()} == {d: (bounds[k], bounds[-1 - k]) for k, d in enumerate(long)}
    own = {"c": _spread(draw, 150, 500, 60), "d": _spread(draw, 40, 300, 200), "only": [(1, 9)], "short": [(0, 30)]}
    other = {"c": _spread(draw, 25, 450, 40), "d": _spread(draw, 12, 200, 20), "q": [(1, 9)], "short": [(3, 7)]}
    rows = lambda sets: [(c, *x) for c, v in sets.items() for x in [*v, *v[:3]]] + [("c", 5, None), ("c", None, 70), (None, 0, 50)]
    want = {}
    for c, v in own.items():
        ends = sorted({p for s, e in other.get(c, []) if e - s >= 5 for p in (s, e)})
        want |= {(c, *d): got for d in v if (got := _best(d, ends))[0] > 0}
    got = intervals.best_spans(frame(rows(own)), frame(rows(other)), 1).collect()
    assert len(got) == len(want) > 100
    for r in got:
        ratio, s, e = want[r["chrom"], r["start"], r["end"]]
        assert (r["hit_start"], r["hit_end"]) == (s, e) and r["ratio"] == pytest.approx(ratio, abs=1e-12)


def _edges(own: list[tuple[int, int]], other: list[tuple[int, int]]) -> set[tuple[tuple[int, int], tuple[int, int]]]:
    """By plain loops: pairs of domains that lie in the best stretch of each other."""
    a, b = ({d for d in v if d[1] - d[0] >= 5} for v in (own, other))
    ends = lambda v: sorted({p for d in v for p in d})
    hit = lambda x, y: {(d, m) for d in x if (h := _best(d, ends(y)))[0] > 0 for m in y if m[0] >= h[1] and m[1] <= h[2]}
    return hit(a, b) & {(d, m) for m, d in hit(b, a)}


def test_mutual_edges_without_joins(spark):
    """Both directions of a chromosome in one group, against plain loops; domains of either set that lie in each other, copies, and sets that miss a chromosome."""
    draw = random.Random(8)
    near = lambda v: [(s + draw.randrange(-3, 4), e + draw.randrange(-3, 4)) for s, e in v]
    own = {"c": _spread(draw, 80, 3000, 60), "d": _spread(draw, 40, 600, 90)}
    sets = [own | {"x": [(0, 9)]}, {c: near(v) for c, v in own.items()} | {"y": [(0, 9)]}]
    one, two = (spark.createDataFrame([(c, *d) for c, v in s.items() for d in [*v, *v[:5]]], "chrom string, start bigint, end bigint") for s in sets)
    df = intervals.mutual_edges(one, two, 1)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    got = [(r["chrom"], (r["t_start"], r["t_end"]), (r["q_start"], r["q_end"])) for r in df.collect()]
    want = {(c, *e) for c in ("c", "d") for e in _edges(sets[0][c], sets[1][c])}
    assert len(got) == len(want) > 20 and set(got) == want


def test_region_pairs_without_joins(spark):
    """Edges, components and counts of a chromosome in one group, against plain loops; copies count as domains, and no table is written."""
    draw = random.Random(12)
    ends = {c: sorted(draw.sample(range(3_000), 150)) for c in ("c", "d")}
    cut = lambda v, share: [p + draw.randrange(-2, 3) for p in v if draw.random() < share]
    flat = lambda v: list(zip(u := sorted(set(v)), u[1:], strict=False))
    sets = [{c: flat(cut(v, share)) for c, v in ends.items()} for share in (0.9, 0.6)]
    rows = [[(c, *d) for c, v in s.items() for d in [*v, *v[:10]]] for s in sets]
    one, two = (spark.createDataFrame(x, "chrom string, start bigint, end bigint") for x in rows)
    want = []
    for c in ends:
        links = _edges(sets[0][c], sets[1][c])
        for part in hierarchy.components({(k, d) for e in links for k, d in enumerate(e)}, [((0, a), (1, b)) for a, b in links]):
            t, q = ((min(d[0] for k, d in part if k == side), max(d[1] for k, d in part if k == side)) for side in (0, 1))
            n = [sum(x == c and s >= out[0] and e <= out[1] and e - s >= 5 for x, s, e in rows[side]) for side, out in enumerate((t, q))]
            want.append((c, *t, *q, *n))
    df = intervals.region_pairs(one, two, 1)
    assert "Join" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "FileScan" not in plan
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and len(want) > 40
    assert {r["class"] for r in intervals.pair_classes(df).collect()} >= {"conserved", "merged", "split"}


@pytest.mark.parametrize("name", ["conserved_pairs", "merged_pairs", "split_pairs"])
def test_classes_of_pairs_without_joins(spark, sf, name):
    """The regions of a class against those of all, from one group a chromosome."""
    from foldspark.queries import queries, views

    df = queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan
    rows = intervals.region_pairs(*(views.segments(spark, sf, k) for k in (0, 1)), 1).collect()
    turn = lambda r: (r[0], *(r[3:5] + r[1:3] + (r[6], r[5]) if name == "split_pairs" else r[1:]))
    one = {"conserved_pairs": lambda t, q: t == q == 1, "merged_pairs": lambda t, q: t > 1 == q, "split_pairs": lambda t, q: q > 1 == t}[name]
    want = sorted(turn(tuple(r)) for r in rows if one(r["n_target"], r["n_query"]))
    assert sorted(tuple(r) for r in df.collect()) == want and want


def test_best_span_looks_at_four_stretches(monkeypatch):
    """A domain that holds 100,000 boundaries: not every stretch between them is looked at. On few against all of them."""
    bounds = list(range(0, 500_005, 5))
    flat = hierarchy.DomainSet([(s, s + 5, 0) for s in bounds[:-1]], 1)
    began = time.process_time()
    assert flat.best_span((3, 499_999)) == ((5, 500_000), pytest.approx(499_994 / 499_997))
    assert time.process_time() - began < 1
    draw = random.Random(10)
    ends = sorted(draw.sample(range(200), 15))
    few = hierarchy.DomainSet([(s, e, 0) for s, e in zip(ends, ends[1:], strict=False)], 1)
    for d in _spread(draw, 300, 220, 90):
        ratio, s, e = _best(d, few.bounds)
        assert few.best_span(d) == (((s, e), ratio) if ratio else None)


def test_inner_changes_are_made_alone(spark, sf):
    """Only rows of the kinds asked for are made, and they are those of the whole alignment; domains of a stretch are those of all leaves' chains."""
    from foldspark.operators import calls
    from foldspark.queries import queries, views

    sets = [views.hierarchy(spark, sf, k) for k in (0, 2)]
    rows = calls.align_sets(*sets, 1).collect()
    key = lambda r: repr(tuple(r))
    for kinds in ({"inner_changed"}, {"split", "disappeared_sub"}, {"pair"}):
        got = calls.align_sets(*sets, 1, kinds).collect()
        assert sorted(map(key, got)) == sorted(key(r) for r in rows if r["kind"] in kinds) and got
    df = queries()["inner_changed_pairs"](spark, sf)
    assert "Filter (kind" not in df._jdf.queryExecution().executedPlan().toString()
    d = hierarchy.DomainSet([(r["start"], r["end"], r["level"]) for r in sets[1].where("chrom = 'BUILDING'").collect()], 1)
    for s, e in ((0, 90), (13, 140), (140, 13)):
        assert d.within(s, e) == sorted({x for k in range(d.deepest + 1) for x in d.within(s, e, k)})


def test_boundary_classes_make_levels_once(spark, sf):
    """Boundaries with and without a partner come from one join: neither the levels of the target nor the pairs are made twice, and nothing but the customers is read."""
    from foldspark.queries import queries, views

    df = queries()["boundary_classes"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1 and {f.rsplit("/", 1)[1] for f in df.inputFiles()} == {"customer.parquet"}
    level = [{(r["chrom"], r["pos"]): r["level"] for r in intervals.boundary_levels(views.hierarchy(spark, sf, k), 1).collect()} for k in (0, 1)]
    last = {}
    for r in sorted(intervals.region_pairs(*(views.segments(spark, sf, k) for k in (0, 1)), 1).collect(), key=lambda r: (r["t_start"], r["t_end"])):
        last |= {(r["chrom"], r["t_start"]): r["q_start"], (r["chrom"], r["t_end"]): r["q_end"]}
    names = {(True, True): "conserved_tad", (False, False): "conserved_sub", (True, False): "tad_to_sub", (False, True): "sub_to_tad"}
    want = []
    for (c, p), v in level[0].items():
        q = last.get((c, p))
        want.append((c, p, q, names[v == 0, level[1][c, q] == 0]) if q is not None else (c, p, None, "disappeared_sub" if v else "disappeared_tad"))
    key = lambda x: (x[0], x[1])
    assert sorted(((r["chrom"], r["pos"], r["q_pos"], r["class"]) for r in df.collect()), key=key) == sorted(want, key=key)
