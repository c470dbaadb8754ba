"""Steps that exist as joins and again inside grouped functions give the same on whole maps; queries without SQL against independent computations."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark import queries as base
from foldspark.operators import calls, feature, hierarchy, intervals, matrix, scores, sequences, tracks
from foldspark.operators.sequences import Contacts, Mixture
from foldspark.plans.pipeline import Genome, training_data
from foldspark.queries import views
from foldspark.queries.views import BINS, DEFAULT, RES


@pytest.fixture(scope="module")
def sf1(sf):
    return sf.replace("sf0.001", "sf0.01")  # enough contacts for calls


@pytest.fixture(scope="module")
def px(spark, sf1):
    return views.pixels(spark, sf1).cache()


@pytest.fixture(scope="module")
def bins(spark, sf1):
    return views.bins(spark, sf1).cache()


@pytest.fixture(scope="module")
def maps(px):
    rows = defaultdict(list)
    for r in px.collect():
        rows[r["chrom"]].append((r["bin1"], r["bin2"], r["v"]))
    return {c: Contacts(BINS, *(np.array(x) for x in zip(*v))) for c, v in rows.items()}


def by(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


def test_noise_contrast_insulation(spark, sf1, px, bins, maps):
    for size in (5, 10, 20, 40):
        domains = views.planted_domains(spark, sf1, size)
        noise, contrast = by(tracks.domain_noise(px, domains), "chrom", "start_bin", "end_bin"), by(scores.domain_contrast(px, domains), "chrom", "start_bin", "end_bin")
        assert len(noise) == 3 * BINS // size
        for c, s, e in noise:
            assert noise[c, s, e]["noise"] == pytest.approx(maps[c].noise(s, e), abs=1e-12) and contrast[c, s, e]["score"] == pytest.approx(maps[c].contrast(s, e), abs=1e-9)
    score = by(tracks.insulation(px, bins), "chrom", "bin")
    assert len(score) == 3 * BINS and all(r["score"] == pytest.approx(maps[c].insulation(b, 5), abs=1e-9) for (c, b), r in score.items())
    near = by(tracks.refine_boundaries(bins.select("dataset", "chrom", "bin"), tracks.insulation(px, bins)), "chrom", "bin")
    assert all(r["refined"] == maps[c].refine(b) for (c, b), r in near.items())


def test_arrowhead(spark, sf1, px, maps):
    got = by(scores.arrowhead(px, views.planted_domains(spark, sf1, 40)), "chrom", "start_bin", "x", "y")
    seen = 0
    for c, m in maps.items():
        for s in range(0, BINS, 40):
            a = m.arrowhead(s, s + 40)
            for x in range(40):
                for y in range(x + 1, 40):
                    r = got.get((c, s, s + x, s + y))
                    assert a[x, y] == pytest.approx(r["a"] if r else 0.0, abs=1e-12)
                    seen += r is not None
    assert seen == len(got) > 1000


def test_windows_index_regions(px, bins, maps):
    """The caller's first windows, index and regions are those of the operators on tables."""
    windows = calls.adaptive_windows(px, bins, DEFAULT)
    track = tracks.trim(tracks.directionality(px, windows, DEFAULT))
    w, di = by(windows, "chrom", "bin"), by(track, "chrom", "bin")
    assert len(w) == len(di) == 3 * BINS and len({r["w"] for r in w.values()}) > 5
    regions = {(r["chrom"], r["start_bin"], r["end_bin"]) for r in tracks.gap_free_regions(track, RES).collect()}
    mine = set()
    for c, m in maps.items():
        caller = sequences.Caller(m, RES)
        caller.start()
        assert caller.windows.tolist() == [w[c, b]["w"] for b in range(BINS)]
        assert np.allclose(caller.index, [di[c, b]["di"] for b in range(BINS)], atol=1e-8)
        mine |= {(c, *r) for r in caller.regions}
    assert mine == regions


def test_models_by_rounds(px, bins):
    """A dataset fitted by all tasks has the model that one task gives."""
    data = training_data(px, bins, RES).cache()
    one, many = (calls.fit_models(data, 25, together=n).collect() for n in (10**9, 0))
    assert len(one) == len(many) == 1 and one[0]["steps"] == many[0]["steps"]
    a, b = (calls.model_from_json(x[0]["model"]) for x in (one, many))
    for k in ("trans", "weight", "mean", "sd"):
        assert np.allclose(getattr(a, k), getattr(b, k), atol=1e-6)
    assert a.end == pytest.approx(b.end) and one[0]["loglik"] == pytest.approx(many[0]["loglik"], rel=1e-9)
    # two datasets that stop at different rounds, one without any sequence that fits
    more = data.unionByName(data.where("chrom = 'A'").withColumn("dataset", F.lit("a"))).unionByName(data.limit(1).withColumn("dataset", F.lit("none")).withColumn("seq", F.array(F.lit(1.0))))
    x, y = ({r["dataset"]: (r["steps"], r["loglik"] and round(r["loglik"], 4)) for r in calls.fit_models(more, 12, together=n).collect()} for n in (10**9, 0))
    assert x == y and x["none"] == (0, None)


def test_levels_bounds_hits(spark, sf):
    for k in (0, 1):
        rows = views.hierarchy(spark, sf, k)
        own = defaultdict(list)
        for r in rows.collect():
            own[r["chrom"]].append((r["start"], r["end"], r["level"]))
        levels, roots = by(intervals.boundary_levels(rows, 1), "chrom", "pos"), by(intervals.leaf_roots(rows, bucket=100), "chrom", "start", "end")
        for c, v in own.items():
            assert hierarchy.levels(d[:2] for d in v) == sorted(v)
            big = [d for d in v if d[1] - d[0] >= 5]
            s = hierarchy.DomainSet(v, 1)
            assert s.level_of == {p: r["level"] for (x, p), r in levels.items() if x == c}
            # the tables keep short domains too
            whole = {d[:2] for d in big}
            for (a, b), root in s.leaf_roots().items():
                if (c, a, b) in roots and (roots[c, a, b]["root_start"], roots[c, a, b]["root_end"]) in whole:
                    assert (roots[c, a, b]["root_start"], roots[c, a, b]["root_end"]) == root[:2]
    a, b = (views.segments(spark, sf, k) for k in (0, 1))
    hits = by(intervals.best_spans(a, b, 1), "chrom", "start", "end")
    for c in {r["chrom"] for r in a.collect()}:
        other = hierarchy.DomainSet([(r["start"], r["end"], 0) for r in b.where(F.col("chrom") == c).collect()], 1)
        for r in a.where(F.col("chrom") == c).collect():
            got, want = hits.get((c, r["start"], r["end"])), other.best_span((r["start"], r["end"]))
            assert (got is None) == (want is None)
            if got:
                assert (got["hit_start"], got["hit_end"]) == want[0] and got["ratio"] == pytest.approx(want[1])


def test_pairs_of_flat_sets(spark, sf):
    """Alignment of one-level sets: the grouped function and the joins give the same regions and classes."""
    for k in ((0, 1), (1, 0), (0, 2), (1, 2)):
        a, b = (views.segments(spark, sf, x) for x in k)
        joins = {(r["chrom"], r["t_start"], r["t_end"], r["q_start"], r["q_end"]): r["class"] for r in intervals.pair_classes(intervals.region_pairs(a, b, 1, bucket=100)).collect()}
        rows = calls.align_sets(a, b, 1).collect()
        of = lambda kind: {(r["chrom"], r["t_start"], r["t_end"], r["q_start"], r["q_end"]) for r in rows if r["kind"] == kind and r["level"] is None}  # noqa: E731, B023
        assert of("pair") == set(joins)
        for kind in ("merged", "split"):
            assert of(kind) == {p for p, c in joins.items() if c == kind}
        assert of("conserved") == {p for p, c in joins.items() if c == "conserved"}


def test_alignment_seen_from_both_sides(spark, sf):
    a, b = (views.hierarchy(spark, sf, k) for k in (0, 1))
    there, back = (Counter((r["kind"], r["chrom"], *p) for r in calls.align_sets(x, y, 1).collect() if r["level"] is None and r["kind"] in kinds for p in [turn(r)]) for x, y, kinds, turn in (
        (a, b, ("pair", "conserved", "inner_changed"), lambda r: (r["t_start"], r["t_end"], r["q_start"], r["q_end"])),
        (b, a, ("pair", "conserved", "inner_changed"), lambda r: (r["q_start"], r["q_end"], r["t_start"], r["t_end"])),
    ))
    assert there == back and len({k[0] for k in there}) >= 2
    same = calls.align_sets(a, a, 1).collect()
    tops = {(r["chrom"], r["start"], r["end"]) for r in a.where("level = 0 and end - start >= 5").collect()}
    assert {(r["chrom"], r["t_start"], r["t_end"]) for r in same if r["kind"] == "conserved"} == tops
    assert not any(r["kind"] in ("inner_changed", "merged", "split") or r["kind"].startswith("disappeared") for r in same)


def test_all_sets_are_single_alignments(spark, sf):
    sets = [views.hierarchy(spark, sf, k) for k in (0, 1, 2)]
    got = calls.align_all(sets[0].unionByName(sets[1]).unionByName(sets[2]), 1).cache()
    for t in range(3):
        for q in range(3):
            if t != q:
                want = Counter(str(tuple(r)) for r in calls.align_sets(sets[t], sets[q], 1).collect())
                assert Counter(str(tuple(r)) for r in got.where(f"tn = '{t}' and qn = '{q}'").drop("tn", "qn").collect()) == want
    assert got.where("tn = qn").count() == 0
    kinds = {r[0] for r in got.select("kind").distinct().collect()}
    assert {"conserved_tad", "conserved_sub", "tad_to_sub", "sub_to_tad", "disappeared_tad", "disappeared_sub"} <= kinds


def test_donut_and_blur_of_a_domain(px, maps):
    """The numpy stencils of a domain and the windows over tables, on the first 60 bins."""
    for c, m in maps.items():
        full = np.zeros((60, 60))
        keep = m.b < 60
        full[m.a[keep], m.b[keep]] = m.v[keep]
        upper = np.triu(full, 5)
        want = feature._quadrants(upper, 5, 5) - feature._quadrants(upper, 5, 2)
        i, j = np.triu_indices(60, 5)
        spark = px.sparkSession
        cells = spark.createDataFrame([("d", c, int(x), int(y), float(upper[x, y]), 1.0) for x, y in zip(i, j)], "dataset string, chrom string, i bigint, j bigint, o double, e double")
        for r in scores.donut(cells.select("dataset", "chrom", "i", "j"), cells).collect():
            assert r["seen"] == pytest.approx(want[r["i"], r["j"]], abs=1e-9)


def test_calls_find_the_planted_blocks(spark, sf1):
    """Both callers end domains at planted blocks; each call's index is the operators' index with the call's own windows."""
    for name in ("single_level_domains", "hierarchical_domains"):
        rows = base.queries()[name](spark, sf1).collect()
        ends = Counter(p // RES % 10 for r in rows for p in (r["start"], r["end"]))
        near = sum(ends[k] for k in (9, 0, 1))
        assert len(rows) > 15 and near >= 0.5 * sum(ends.values())  # by chance 0.3
    for r in rows:
        assert 0 <= r["start"] < r["end"] <= BINS * RES and r["level"] >= 0
    again = hierarchy.levels
    for c in {r["chrom"] for r in rows}:
        own = sorted((r["start"], r["end"], r["level"]) for r in rows if r["chrom"] == c)
        assert again(d[:2] for d in own) == own


def test_bottoms_from_states(spark, sf1):
    """Bottom domains lie between the states' boundaries; state paths are those of the fitted model on each region."""
    q = base.queries()
    models = {r["dataset"]: calls.model_from_json(r["model"]) for r in q["hmm_fit"](spark, sf1).collect()}
    states = defaultdict(list)
    for r in q["viterbi_states"](spark, sf1).orderBy("chrom", "start_bin", "bin").collect():
        states[r["chrom"], r["start_bin"]].append((r["bin"], r["state"]))
    di = by(q["di_adaptive"](spark, sf1), "chrom", "bin")
    for (c, s), rows in states.items():
        assert [b for b, _ in rows] == list(range(s, s + len(rows)))
        assert [x for _, x in rows] == sequences.viterbi(models["d"], np.array([di[c, b]["di"] for b, _ in rows])).tolist()
    got = sorted((r["chrom"], r["start_bin"], r["domain_start"], r["domain_end"]) for r in q["bottom_domains"](spark, sf1).collect())
    want = []
    for (c, s), rows in states.items():
        cuts = [rows[0][0], *[b for (_, x), (b, y) in zip(rows, rows[1:]) if x == 3 and y == 0], rows[-1][0] + 1]
        want += [(c, s, a, b) for a, b in zip(cuts, cuts[1:]) if b - a >= 5]
    assert got == sorted(want) and len(got) > 10


def test_consensus_of_equal_replicates(spark, sf1):
    """Replicates that agree keep what each of them has; the query's consensus lies within both replicates' spans."""
    px, b = views.pixels(spark, sf1), views.bins(spark, sf1)
    rep = lambda df, k: df.withColumn("dataset", F.lit(f"r{k}"))
    one = Genome(px, b, RES)
    alone = {tuple(r)[:3] for r in one.call_hierarchy().collect()}
    both = Genome(rep(px, 0).unionByName(rep(px, 1)), rep(b, 0).unionByName(rep(b, 1)), RES)
    twice = {tuple(r)[:3] for r in both.call_hierarchy().collect()}
    long = lambda rows: {r for r in rows if r[2] - r[1] >= 5 * RES}
    # holes between domains may be filled, which a lone replicate is not
    assert len(long(alone) & long(twice)) >= 0.8 * len(long(alone))
    for g in (one, both):
        g.wipe()
    rows = base.queries()["consensus_domains"](spark, sf1).collect()
    assert all(0 <= r["start"] < r["end"] <= BINS * RES for r in rows)


def test_features_of_domains(spark, sf1, maps):
    """Each domain's feature from its dense matrix; cover is the average of the accepted ones."""
    got = base.queries()["aggregation_preference"](spark, sf1).collect()
    assert len(got) == 15
    cover = defaultdict(list)
    for r in got:
        s, e = r["start"] // RES, r["end"] // RES
        a, b, v = maps[r["chrom"]].inside(s, e)
        m = np.zeros((e - s, e - s))
        m[a - s, b - s] = m[b - s, a - s] = v
        want = feature.domain_feature(m)
        assert all(r[k] == pytest.approx(want[k], abs=1e-9) for k in ("ap", "gap_ratio", "cover", "n_points", "n_clusters"))
        if r["ap"] >= 0:
            cover[r["chrom"]].append(r["cover"])
    rows = {r["chrom"]: r["cover"] for r in base.queries()["coverage"](spark, sf1).collect()}
    assert set(rows) == set(cover) and all(rows[c] == pytest.approx(np.mean(v)) for c, v in cover.items())


def test_dbscan_labels(spark, sf):
    """Clusters by joins and components, against plain loops, group by group."""
    got = defaultdict(dict)
    for r in base.queries()["dbscan_labels"](spark, sf).collect():
        got[r["g"]][r["id"]] = (r["x"], r["y"], r["core"], r["cluster"])
    par = {r["g"]: r for r in base.queries()["dbscan_params"](spark, sf).collect()}
    for g, rows in got.items():
        ids = sorted(rows)
        p = np.array([rows[i][:2] for i in ids], float)
        label, core = feature.dbscan(p, max(par[g]["eps"], math.sqrt(2)), par[g]["min_points"])
        assert core.tolist() == [rows[i][2] for i in ids]
        # a lone border point between clusters goes to the first; numbers follow the first core points
        assert label.tolist() == [rows[i][3] for i in ids]
    sparse = spark.createDataFrame([(0, i, int(x), int(y)) for i, (x, y) in enumerate(np.random.default_rng(5).integers(0, 60, (150, 2)))], "g bigint, id bigint, x bigint, y bigint")
    params = spark.createDataFrame([(0, 4, 5.0)], "g bigint, min_points bigint, eps double")
    rows = sorted(map(tuple, scores.dbscan_labels(sparse, params, ["g"]).select("id", "x", "y", "core", "cluster").collect()))
    label, core = feature.dbscan(np.array([r[1:3] for r in rows], float), 5.0, 4)
    assert label.tolist() == [r[4] for r in rows] and core.tolist() == [r[3] for r in rows] and len(set(label)) > 4


def test_cluster_radii(spark):
    """Radius and density of a domain's clusters, as the grouped function has them."""
    rng = np.random.default_rng(8)
    m = rng.poisson(4, (60, 60)).astype(float)
    m = np.triu(m) + np.triu(m, 1).T
    for r, c in ((8, 40), (20, 50)):
        m[r : r + 5, c : c + 5] += 50
        m[c : c + 5, r : r + 5] += 50
    own = feature.DomainMap(m)
    own.significant_cells()
    k = own.parameters()[1]
    eps = max(own.parameters()[0], math.sqrt(2))
    own.cluster()
    _, core = feature.dbscan(own.points.astype(float), eps, k)
    rows = [(0, i, int(x), int(y), bool(core[i]), int(own.labels[i]), k) for i, (x, y) in enumerate(own.points)]
    df = spark.createDataFrame(rows, "g bigint, id bigint, x bigint, y bigint, core boolean, cluster bigint, min_points bigint")
    got = {r["cluster"]: r for r in scores.cluster_radii(df, ["g"]).collect()}
    assert len(got) == len(own.clusters) >= 1
    for i, c in enumerate(own.clusters):
        assert got[i]["size"] == c["size"] and got[i]["radius"] == pytest.approx(c["radius"]) and got[i]["density"] == pytest.approx(c["density"])


def test_decay_fit(spark, sf1):
    """The spline from a full system of its cubics' coefficients, held from its first turn on."""
    rows = defaultdict(list)
    for r in base.queries()["decay_fit"](spark, sf1).orderBy("chrom", "d").collect():
        rows[r["chrom"]].append((r["mean_v"], r["fit"]))
    exact = {c: [r["mean_v"] for r in sorted(v, key=lambda r: r["d"])] for c, v in _decay(spark, sf1).items()}
    for c, v in rows.items():
        y = np.array(exact[c])
        x = np.arange(len(y), dtype=float)
        knots = np.linspace(0, len(y) - 1, len(y) // 3)
        at = np.interp(knots, x, y)
        n = len(knots) - 1
        a, b, k = np.zeros((4 * n, 4 * n)), np.zeros(4 * n), 0
        power = lambda t: np.array([1, t, t * t, t**3])
        slope = lambda t: np.array([0, 1, 2 * t, 3 * t * t])
        bend = lambda t: np.array([0, 0, 2, 6 * t])
        h = knots[1] - knots[0]
        for i in range(n):
            for t, value in ((0, at[i]), (h, at[i + 1])):
                a[k, 4 * i : 4 * i + 4], b[k] = power(t), value
                k += 1
        for i in range(n - 1):
            for f in (slope, bend):
                a[k, 4 * i : 4 * i + 4], a[k, 4 * i + 4 : 4 * i + 8] = f(h), -f(0)
                k += 1
        for i in (0, n - 2):  # the third derivative goes through the outer inner knots
            a[k, 4 * i + 3], a[k, 4 * i + 7] = 1, -1
            k += 1
        coefficients = np.linalg.solve(a, b).reshape(n, 4)
        piece = np.minimum((x / h).astype(int), n - 1)
        want = np.array([coefficients[i] @ power(t - i * h) for i, t in zip(piece, x)])
        d = np.gradient(want)
        turn = next((i for i in range(len(d) - 1) if d[i] <= 0 <= d[i + 1]), None)
        if turn is not None:
            want[turn:] = want[turn]
        assert np.allclose([f for _, f in v], want, atol=1e-5)


def _decay(spark, sf1):
    out = defaultdict(list)
    for r in matrix.distance_decay(views.pixels(spark, sf1), views.sizes(spark, sf1)).collect():
        out[r["chrom"]].append(r)
    return out


def test_initial_model_is_a_model():
    m = Mixture.initial()
    assert np.allclose(m.trans.sum(axis=1) + np.array([0, 0, 0, m.end]), 1) and np.allclose(m.weight.sum(axis=1), 1)
