"""Set-based scores of domains and of cells: contrast at the ends, arrowhead values, donut backgrounds. Domain ends are in bins here."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.operators.matrix import KEY

DOMAIN = [*KEY, "start_bin", "end_bin"]


def _inside(pixels: DataFrame, domains: DataFrame) -> DataFrame:
    """Pixels more than one off the diagonal by domain: domains are sent to their rows, an equi-join with the pixels' rows."""
    rows = domains.select(*DOMAIN, F.explode(F.sequence("start_bin", F.col("end_bin") - 1)).alias("bin1"))
    return rows.join(pixels.where("bin2 - bin1 > 1"), [*KEY, "bin1"]).where("bin2 < end_bin")


def domain_contrast(pixels: DataFrame, domains: DataFrame) -> DataFrame:
    """(start_bin, end_bin, score): mean of half of (in - out) / (in + out) over inner contacts and equally long ones across an end; 0 unless more than three."""
    inner = _inside(pixels, domains).withColumn("d", F.col("bin2") - F.col("bin1"))
    outer = pixels.select(*KEY, F.col("bin1").alias("o1"), F.col("bin2").alias("o2"), F.col("v").alias("out"))
    up = inner.where("bin1 - d <= start_bin").withColumns({"o1": F.col("bin1") - F.col("d"), "o2": F.col("bin1")})
    down = inner.where("bin2 + d >= end_bin").withColumns({"o1": F.col("bin2"), "o2": F.col("bin2") + F.col("d")})
    pairs = up.unionByName(down).join(outer, [*KEY, "o1", "o2"])
    got = pairs.groupBy(*DOMAIN).agg(F.count("*").alias("n"), F.avg(0.5 * (F.col("v") - F.col("out")) / (F.col("v") + F.col("out"))).alias("m"))
    score = F.when(F.col("n") > 3, F.col("m")).otherwise(F.lit(0.0))
    return domains.select(*DOMAIN).distinct().join(got, DOMAIN, "left").select(*DOMAIN, F.coalesce(score, F.lit(0.0)).alias("score"))


def runs(domains: DataFrame, longest_bins: int, noisy: float = 0.2) -> DataFrame:
    """All runs of consecutive bottom domains (region, start_bin, end_bin, noise) as domains: single ones, and those no longer than ``longest_bins`` with quiet ends.

    A run's last domain begins in the bucket of ``longest_bins`` positions of the first one's start or in the next.
    """
    rows = domains.select(*KEY, "region", "start_bin", "end_bin", "noise")
    quiet = rows.where(F.col("noise") <= noisy).withColumn("bucket", F.floor(F.col("start_bin") / max(1, longest_bins)))
    far = quiet.select(*KEY, "region", "bucket", F.col("start_bin").alias("s2"), F.col("end_bin").alias("e2"))
    near = quiet.withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") + 1)))
    pairs = near.join(far, [*KEY, "region", "bucket"]).where((F.col("s2") > F.col("start_bin")) & (F.col("e2") - F.col("start_bin") <= longest_bins))
    return rows.select(*KEY, "region", "start_bin", "end_bin").unionByName(pairs.select(*KEY, "region", "start_bin", F.col("e2").alias("end_bin"))).distinct()


def run_scores(pixels: DataFrame, domains: DataFrame, longest_bins: int) -> DataFrame:
    return domain_contrast(pixels, runs(domains, longest_bins))


def arrowhead(pixels: DataFrame, domains: DataFrame) -> DataFrame:
    """(start_bin, end_bin, x, y, a) for cells x < y of the domain with a contact here or at (x - d, x): a = (C(x - d, x) - C(x, y)) / their sum."""
    rows = domains.select(*DOMAIN, F.explode(F.sequence("start_bin", F.col("end_bin") - 1)).alias("x"))
    both = F.array(
        F.struct(F.col("bin1").alias("x"), F.col("bin2").alias("y"), F.col("v").alias("here"), F.lit(0.0).alias("up")),
        F.struct(F.col("bin2").alias("x"), (2 * F.col("bin2") - F.col("bin1")).alias("y"), F.lit(0.0).alias("here"), F.col("v").alias("up")),
    )
    cells = pixels.where("bin2 > bin1").select(*KEY, F.explode(both).alias("s")).select(*KEY, "s.*").groupBy(*KEY, "x", "y").agg(F.sum("here").alias("here"), F.sum("up").alias("up"))
    got = rows.join(cells, [*KEY, "x"]).where("y < end_bin")
    return got.select(*DOMAIN, "x", "y", ((F.col("up") - F.col("here")) / (F.col("up") + F.col("here"))).alias("a"))


def subdomain_scores(pixels: DataFrame, outer: DataFrame, keys: DataFrame) -> DataFrame:
    """(start_bin, end_bin, o_bin, e_bin, score): how well [o_bin, e_bin) stands out inside an outer domain, from its arrowhead values.

    Cells are those more than one off the diagonal whose value is strictly between -1 and 1, with 0 where neither contact exists. They are the outer domain's dense
    triangle, at most its squared bins. 0 unless more than three cells.
    """
    rows = outer.select(*DOMAIN, F.explode(F.sequence("start_bin", F.col("end_bin") - 1)).alias("x"))
    wide = rows.where("x + 2 < end_bin").select(*DOMAIN, "x", F.explode(F.sequence(F.col("x") + 2, F.col("end_bin") - 1)).alias("y"))
    a = wide.join(arrowhead(pixels, outer), [*DOMAIN, "x", "y"], "left").select(*DOMAIN, "x", "y", F.coalesce("a", F.lit(0.0)).alias("a")).where("abs(a) <> 1")
    cells = a.join(keys.select(*DOMAIN, "o_bin", "e_bin"), DOMAIN)
    one = (F.col("y") >= F.col("e_bin")) & (F.col("x") < F.col("e_bin")) & (2 * F.col("x") - F.col("y") >= F.col("o_bin"))
    two = (F.col("y") < F.col("e_bin")) & (F.col("x") >= F.col("o_bin")) & (2 * F.col("x") - F.col("y") >= F.col("start_bin")) & (2 * F.col("x") - F.col("y") <= F.col("o_bin"))
    both = F.filter(F.array(F.when(one, F.col("a")), F.when(two, -F.col("a"))), lambda x: x.isNotNull())
    parts = cells.select(*DOMAIN, "o_bin", "e_bin", F.explode(both).alias("p"))
    got = parts.groupBy(*DOMAIN, "o_bin", "e_bin").agg(F.count("*").alias("n"), F.avg(0.5 * F.col("p")).alias("m"))
    out = keys.select(*DOMAIN, "o_bin", "e_bin").join(got, [*DOMAIN, "o_bin", "e_bin"], "left")
    return out.select(*DOMAIN, "o_bin", "e_bin", F.when(F.col("n") > 3, F.col("m")).otherwise(F.lit(0.0)).alias("score"))


#: Bins along a side of a tile of cells.
TILE = 256


def _tiles(c: str, reach: int) -> Column:
    """The tiles whose cells are within ``reach`` of a bin."""
    return F.explode(F.array_distinct(F.array(F.floor((F.col(c) - reach) / TILE), F.floor((F.col(c) + reach) / TILE))))


def _shifted(grid: np.ndarray, offsets: Iterable[int], reach: int, axis: int) -> np.ndarray:
    """Sums of ``grid`` at ``offsets`` along an axis, which becomes shorter by ``reach`` on both sides."""
    n = grid.shape[axis] - 2 * reach
    return sum(grid[reach + k : reach + k + n] if axis == 0 else grid[:, reach + k : reach + k + n] for k in offsets)


def _stencil(cells: DataFrame, sent: DataFrame | None, values: list[str], reach: int, added: list[str], run: Callable[..., list[np.ndarray]], lines: DataFrame | None = None) -> DataFrame:
    """``cells`` (i, j: bins from 0) with the doubles ``added`` that ``run`` gives for their tile from grids of ``values`` (sums by cell, 0 elsewhere), ``reach`` wider than the tile on every side.

    ``sent`` (i, j, values; ``cells`` themselves where it is None) go to the tiles they reach. ``lines`` (n_bins, at, n) go to the tiles of row and of column ``at``: ``run`` gets n of the
    tile's rows and of its columns too. A group is a tile with what reaches it, whatever the chromosome's length.
    """
    names = cells.columns
    near = lambda df: df.withColumn("_ti", _tiles("i", reach)).withColumn("_tj", _tiles("j", reach)).withColumn("_kind", F.lit(0))
    tile = lambda c: F.floor(F.col(c) / TILE)
    if sent is None:
        rows = near(cells).withColumn("_own", (tile("i") == F.col("_ti")) & (tile("j") == F.col("_tj")))
    else:
        rows = cells.select("*", tile("i").alias("_ti"), tile("j").alias("_tj"), F.lit(True).alias("_own"))
        rows = rows.unionByName(near(sent.select(*KEY, "i", "j", *[F.col(v).alias("_" + v) for v in values])).withColumn("_own", F.lit(False)), True)
        values = ["_" + v for v in values]
    if lines is not None:
        wide = lines.select(*KEY, "at", "n", tile("at").alias("t"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_bins") - 1) / TILE))).alias("u"))
        way = lambda ti, tj, kind: F.struct(F.col(ti).alias("_ti"), F.col(tj).alias("_tj"), F.lit(kind).alias("_kind"))
        wide = wide.select(*KEY, F.col("at").alias("i"), F.col("n").cast("double").alias("_n"), F.explode(F.array(way("t", "u", 1), way("u", "t", 2))).alias("w"))
        rows = rows.unionByName(wide.select(*KEY, "i", "_n", "w.*", F.lit(False).alias("_own")), True)
    side, lined = TILE + 2 * reach, lines is not None

    def fill(table: pa.Table) -> pa.Table:
        out = table.filter(table.column("_own")).select(names)
        if not out.num_rows:
            return pa.table({**{c: out.column(c) for c in names}, **{c: pa.array([], pa.float64()) for c in added}})
        ti, tj = table.column("_ti")[0].as_py(), table.column("_tj")[0].as_py()
        of = lambda kind: table.filter(pc.equal(table.column("_kind"), kind))
        give = of(0)
        i, j = (give.column(c).to_numpy() - t * TILE + reach for c, t in (("i", ti), ("j", tj)))
        parts = [np.bincount(i * side + j, give.column(v).to_numpy(), side * side).reshape(side, side) for v in values]
        if lined:
            parts += [np.bincount(x.column("i").to_numpy() - t * TILE, x.column("_n").to_numpy(), TILE) for x, t in ((of(1), ti), (of(2), tj))]
        x, y = out.column("i").to_numpy() - ti * TILE, out.column("j").to_numpy() - tj * TILE
        for name, grid in zip(added, run(*parts), strict=True):
            out = out.append_column(name, pa.array(grid[x, y], pa.float64()))
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields) + "".join(f", {c} double" for c in added)
    return rows.groupBy(*KEY, "_ti", "_tj").applyInArrow(fill, schema)


def _rings(pw: int, ww: int) -> Callable[[np.ndarray], np.ndarray]:
    """Sums over the square around each cell without the inner one and the middle row and column; a grid becomes smaller by ``ww`` on every side."""
    wide = [k for k in range(-ww, ww + 1) if k]
    far, close = ([k for k in wide if (abs(k) > pw) is side] for side in (True, False))
    return lambda g: _shifted(_shifted(g, wide, ww, 1), far, ww, 0) + _shifted(_shifted(g, far, ww, 1), close, ww, 0)


def donut(cells: DataFrame, sources: DataFrame, pw: int = 2, ww: int = 5) -> DataFrame:
    """``cells`` (i, j) with seen and hoped: sums of ``sources`` (i, j, o, e) over the square around each without the inner one and the middle row and column."""
    ring = _rings(pw, ww)
    return _stencil(cells, None if sources is cells else sources, ["o", "e"], ww, ["seen", "hoped"], lambda *grids: [ring(g) for g in grids])


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Doubles rounded half up at so many decimals of their shortest form, as ``round`` of Spark and of SQL does, and without negative zeros.

    Only where the error of the product could decide, each is rounded by its decimals.
    """
    scale = 10.0**digits
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.abs(x) * scale
        whole = np.floor(y)
        out = np.copysign(np.floor(y + 0.5) / scale, x)
        near = np.isfinite(x) & ((np.abs(y - whole - 0.5) <= y * 1e-15) | ~(y < 2.0**52))
    out = np.where(np.isfinite(x), out, x)
    exact, unit = Context(prec=400), Decimal(1).scaleb(-digits)
    out[near] = [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP, exact)) for v in x[near].tolist()]
    return out + 0.0


def every_cell(
    pixels: DataFrame, sizes: DataFrame, decay: DataFrame, wanted: list[str], least: int = 5, pw: int = 2, ww: int = 5, made: dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]] | None = None
) -> DataFrame:
    """All cells (i, j; j - i >= ``least``) of whole maps with the columns ``wanted``, of o and e (value and mean of the distance), seen and hoped (:func:`donut` of the cells' o and e) and blur (:func:`blurred`).

    ``sizes``: (dataset, chrom, n); ``decay``: (dataset, chrom, d, mean_v) for every distance from 0. Cells are not rows before they are results: a tile gets the pixels that reach it and one
    row with its part of the decay and of the full columns, and makes its own cells. With ``made``, the columns that its functions make from those wanted (arrays by name; NaN becomes null)
    are returned in their place, so that what a column is made of does not leave the tile.
    """
    reach, square, ring = max(pw, ww), range(-pw, pw + 1), _rings(pw, ww)
    rows = pixels.select(*KEY, F.col("bin1").alias("i"), F.col("bin2").alias("j"), "v").withColumn("_ti", _tiles("i", reach)).withColumn("_tj", _tiles("j", reach)).where("_ti <= _tj")
    means = decay.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("d", "mean_v"))).alias("m")).select(*KEY, F.col("m.mean_v").alias("_means"))
    tiles = sizes.select(*KEY, F.col("n").alias("_n")).join(means, KEY)
    if "blur" in wanted:
        # by the greatest value, not distinct: so the plan reads what the others read
        full = pixels.groupBy(*KEY, "bin2").agg(F.max("v").alias("m")).where("m is not null").groupBy(*KEY).agg(F.collect_list("bin2").alias("_full"))
        tiles = tiles.join(full, KEY, "left")
    last = F.floor((F.col("_n") - 1) / TILE)
    tiles = tiles.withColumn("_ti", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn("_tj", F.explode(F.sequence("_ti", last)))
    # the least distance in a tile and its margins
    first = F.greatest((F.col("_tj") - F.col("_ti") - 1) * TILE + 1 - 2 * reach, F.lit(0).cast("bigint"))
    tiles = tiles.withColumn("_first", first).withColumn("_means", F.slice("_means", F.col("_first").cast("int") + 1, 2 * TILE + 4 * reach))
    if "blur" in wanted:
        near = lambda c, x: (x >= F.col(c) * TILE - pw) & (x < (F.col(c) + 1) * TILE + pw)
        tiles = tiles.withColumn("_full", F.filter("_full", lambda x: near("_ti", x) | near("_tj", x)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.select(*KEY).schema.fields) + ", i bigint, j bigint" + "".join(f", {c} double" for c in made or wanted)

    def fill(give: pa.Table, head: pa.Table) -> pa.Table:
        if not head.num_rows:  # pixels beyond the ends
            return pa.table({**{c: give.column(c).slice(0, 0) for c in KEY}, "i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in made or wanted}})
        ti, tj, n, first = (head.column(c)[0].as_py() for c in ("_ti", "_tj", "_n", "_first"))
        # bins of the wide grid
        a, b = (np.arange(t * TILE - reach, min((t + 1) * TILE, n) + reach) for t in (ti, tj))
        give = give.filter(give.column("v").is_valid())
        i, j, v = give.column("i").to_numpy() - a[0], give.column("j").to_numpy() - b[0], give.column("v").to_numpy()
        ok = (i < len(a)) & (j < len(b))
        grid = np.bincount(i[ok] * len(b) + j[ok], v[ok], len(a) * len(b)).reshape(len(a), len(b))
        d = b - a[:, None]
        own = (d >= least) & (a >= 0)[:, None] & (b < n)
        means = head.column("_means").combine_chunks().flatten().to_numpy()
        seen, hoped = np.where(own, grid, 0), np.where(own, means[np.where(own, d - first, 0)], 0)
        core = (slice(reach, len(a) - reach), slice(reach, len(b) - reach))
        trim = lambda g, k: g[reach - k : len(a) - reach + k, reach - k : len(b) - reach + k]
        x, y = np.nonzero(own[core])
        values = {}
        for c in wanted:
            if c in ("o", "e"):
                got = (seen if c == "o" else hoped)[core]
            elif c in ("seen", "hoped"):
                got = ring(trim(seen if c == "seen" else hoped, ww))
            else:
                full = head.column("_full").combine_chunks().flatten().to_numpy()
                ni, nj = (_shifted(np.isin(np.arange(p[reach] - pw, p[-1] - reach + pw + 1), full).astype(float)[:, None], square, pw, 0)[:, 0] for p in (a, b))
                got = _mean_square(trim(grid, pw), ni, nj, pw)
            values[c] = got[x, y]
        if made:
            values = {c: f(values) for c, f in made.items()}
        out = {c: pa.repeat(head.column(c)[0], len(x)) for c in KEY} | {"i": pa.array(x + ti * TILE), "j": pa.array(y + tj * TILE)}
        return pa.table(out | {c: pa.array(v, pa.float64(), from_pandas=bool(made)) for c, v in values.items()})

    # not one table of both: with each row of a batch, Spark goes through its lists anew
    return rows.groupBy(*KEY, "_ti", "_tj").cogroup(tiles.groupBy(*KEY, "_ti", "_tj")).applyInArrow(fill, schema)


def corrected_expected(cells: DataFrame) -> DataFrame:
    """Cells (e, seen, hoped, as :func:`donut` gives them) with ``corrected``, the expected value scaled by what is seen around over what is hoped for there (1 where nothing is)."""
    return cells.withColumn("corrected", F.col("e") * F.col("seen") / F.when(F.col("hoped") == 0, 1.0).otherwise(F.col("hoped")))


def _mean_square(grid: np.ndarray, ni: np.ndarray, nj: np.ndarray, pw: int) -> np.ndarray:
    """Sums over the square around each cell by the product of the full columns near its row's bin and near its column's."""
    square, count = range(-pw, pw + 1), np.outer(ni, nj)
    return np.where(count > 0, _shifted(_shifted(grid, square, pw, 1), square, pw, 0) / np.maximum(count, 1), 0.0)


def blurred(cells: DataFrame, pixels: DataFrame, sizes: DataFrame, pw: int = 2) -> DataFrame:
    """``cells`` (i, j) with blur: sum of the upper triangle over the square around each, by the number of its cells whose bins both have a value in their column."""
    # the count is a product: full columns near i times full columns near j
    full = pixels.select(*KEY, F.col("bin2").alias("bin")).distinct()
    near = full.select(*KEY, F.explode(F.sequence(F.col("bin") - pw, F.col("bin") + pw)).alias("at")).groupBy(*KEY, "at").agg(F.count("*").alias("n"))
    near = near.join(sizes.select(*KEY, F.col("n").alias("n_bins")), KEY).where("at >= 0 and at < n_bins")

    return _stencil(cells, pixels.select(*KEY, F.col("bin1").alias("i"), F.col("bin2").alias("j"), "v"), ["v"], pw, ["blur"], lambda grid, ni, nj: [_mean_square(grid, ni, nj, pw)], near)


def top_cells(cells: DataFrame, top: float = 0.7, ratio: float = 0.05) -> DataFrame:
    """``cells`` (i, j, blur, p) in the ``top`` share by blur, then of those with a p-value the ceil(ratio / top) share with the least; ties by (i, j)."""
    n = F.count("*").over(Window.partitionBy(*KEY))
    by_blur = F.row_number().over(Window.partitionBy(*KEY).orderBy("blur", "i", "j"))
    kept = cells.withColumns({"n": n, "k": by_blur}).where(F.col("k") > F.floor((1 - F.lit(top)) * F.col("n"))).where("p is not null")
    m = F.count("*").over(Window.partitionBy(*KEY))
    by_p = F.row_number().over(Window.partitionBy(*KEY).orderBy("p", "i", "j"))
    return kept.withColumns({"m": m, "r": by_p}).where(F.col("r") <= F.ceil(F.lit(ratio / top) * F.col("m"))).drop("n", "k", "m", "r")


def cluster_parameters(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_points, min_points, eps) from the number of points (x, y) and their bounding box."""
    got = points.groupBy(*keys).agg(F.count("*").alias("n_points"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).cast("double").alias("box"))
    k = F.ceil(F.col("n_points") / 25) + 1
    return got.select(*keys, "n_points", k.cast("bigint").alias("min_points"), F.sqrt(F.col("box") * k / (F.col("n_points") * F.pi())).alias("eps"))


def core_points(points: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (id, x, y) with near (points within eps, itself included) and core; eps is at least the root of two.

    Points of one position are counted first; positions meet their neighbours on a grid of eps cells.
    """
    at = points.groupBy(*keys, "x", "y").agg(F.count("*").alias("w"))
    at = at.join(params.select(*keys, "min_points", F.greatest("eps", F.lit(2.0**0.5)).alias("r")), keys)
    at = at.withColumns({"gx": F.floor(F.col("x") / F.col("r")), "gy": F.floor(F.col("y") / F.col("r"))})
    shift = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    other = at.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("w").alias("w2"), "gx", "gy")
    mine = at.select(*keys, "x", "y", "min_points", "r", "gx", "gy", F.explode(shift).alias("t")).withColumns({"gx": F.col("gx") + F.col("t.a"), "gy": F.col("gy") + F.col("t.b")})
    close = mine.join(other, [*keys, "gx", "gy"]).where("(x - x2) * (x - x2) + (y - y2) * (y - y2) <= r * r")
    near = close.groupBy(*keys, "x", "y", "min_points").agg(F.sum("w2").alias("near"))
    return points.select(*keys, "id", "x", "y").join(near, [*keys, "x", "y"]).select(*keys, "id", "x", "y", "near", (F.col("near") >= F.col("min_points")).alias("core"))


def dbscan_labels(points: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (id, x, y; ids distinct) with core and cluster: numbered by the least id of their core points from 0, -1 for noise; a border point belongs to the first cluster near it.

    Core positions are nodes of a graph whose edges join those within eps; clusters are its components.
    """
    from foldspark.operators.graph import connected_components

    cores = core_points(points, params, keys)
    at = cores.groupBy(*keys, "x", "y").agg(F.max("core").alias("core"), F.min("id").alias("least"))
    at = at.join(params.select(*keys, F.greatest("eps", F.lit(2.0**0.5)).alias("r")), keys)
    at = at.withColumns({"gx": F.floor(F.col("x") / F.col("r")), "gy": F.floor(F.col("y") / F.col("r")), "node": F.concat_ws(":", *keys, F.lpad(F.col("least").cast("string"), 20, "0"))})
    shift = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    other = at.where("core").select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("node").alias("to"), "gx", "gy")
    mine = at.select(*keys, "x", "y", "core", "node", "r", "gx", "gy", F.explode(shift).alias("t")).withColumns({"gx": F.col("gx") + F.col("t.a"), "gy": F.col("gy") + F.col("t.b")})
    near = mine.join(other, [*keys, "gx", "gy"]).where("(x - x2) * (x - x2) + (y - y2) * (y - y2) <= r * r")
    comps = connected_components(at.where("core").select(F.col("node").alias("id")), near.where("core").select(F.col("node").alias("a"), F.col("to").alias("b")))
    # a position's cluster is the first of those of the core positions near it; for a core position all are its own
    first = near.join(comps.withColumnRenamed("id", "to"), "to").groupBy(*keys, "x", "y").agg(F.min("comp").alias("comp"))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("comp")) - 1
    first = first.select(*keys, "x", "y", number.alias("cluster"))
    return cores.select(*keys, "id", "x", "y", "core").join(first, [*keys, "x", "y"], "left").select(*keys, "id", "x", "y", "core", F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))


def drop_lone_clusters(points: DataFrame, keys: list[str]) -> DataFrame:
    """Labelled points (cluster, -1 for noise) without clusters of one point, the rest numbered densely in order."""
    size = F.count("*").over(Window.partitionBy(*keys, "cluster"))
    kept = points.withColumn("size", size).where((F.col("cluster") == -1) | (F.col("size") > 1))
    number = F.dense_rank().over(Window.partitionBy(*keys, F.col("cluster") == -1).orderBy("cluster")) - 1
    return kept.withColumn("cluster", F.when(F.col("cluster") == -1, F.lit(-1)).otherwise(number)).drop("size")


#: Positions of a leaf, which are compared with all near leaves at once.
LEAF = 64


def _leaves(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Places of points in halves of halves along the longer side, until ``LEAF`` or fewer are left."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        side = x if np.ptp(x[at]) >= np.ptp(y[at]) else y
        half = np.argpartition(side[at], len(at) // 2)
        todo += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
    return out


def near_distances(x: np.ndarray, y: np.ndarray, n: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least distances, in order, from each of the positions ``asked`` to the other points; ``n``: points by (distinct) position. Inf where there are fewer.

    Of a position at most k + 1 points can be among the nearest. The distances in a point's own leaf bound its search: only leaves as near as that can hold nearer ones.
    """
    copies = np.repeat(np.arange(len(x)), np.minimum(n, k + 1))
    px, py = x[copies].astype(float), y[copies].astype(float)
    parts = _leaves(px, py)
    box = np.array([[px[p].min(), px[p].max(), py[p].min(), py[p].max()] for p in parts])
    first = np.full(len(x), -1)
    first[copies[::-1]] = np.arange(len(copies))[::-1]
    want = np.zeros(len(copies), bool)
    want[first[asked]] = True
    out = np.full((len(x), k), np.inf)

    def least(mine: np.ndarray, others: np.ndarray) -> np.ndarray:
        d = np.sqrt((px[mine][:, None] - px[others]) ** 2 + (py[mine][:, None] - py[others]) ** 2)
        d[mine[:, None] == others] = np.inf
        if d.shape[1] > k:
            d = np.partition(d, k - 1, axis=1)[:, :k]
        d.sort(axis=1)
        return d

    for part in parts:
        mine = part[want[part]]
        if not len(mine):
            continue
        own = least(mine, part)
        bound = own[:, k - 1].max() if own.shape[1] >= k else np.inf
        low_x, high_x, low_y, high_y = px[mine].min(), px[mine].max(), py[mine].min(), py[mine].max()
        gap_x, gap_y = np.maximum(0, np.maximum(box[:, 0] - high_x, low_x - box[:, 1])), np.maximum(0, np.maximum(box[:, 2] - high_y, low_y - box[:, 3]))
        near = np.flatnonzero(gap_x**2 + gap_y**2 <= bound**2 * (1 + 1e-9))
        got = least(mine, np.concatenate([parts[q] for q in near]))
        out[copies[mine], : got.shape[1]] = got
    return out


def cluster_radii(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster, size, radius, density) of labelled points (id, x, y, core, cluster, min_points; -1 is noise), from every core point's min_points - 1 nearest other members.

    With s the sum of their distances (of all others where there are fewer), radius is the mean of s / (min_points - 1), density that of its inverse; without any s > 0 it is null. Points
    of one position are counted first; a group is the positions of one cluster, and no pairs of points are made but those of near leaves.
    """
    own = points.where("cluster >= 0")
    by = [*keys, "cluster"]
    at = own.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*by, "x", "y", "min_points").agg(F.count("*").alias("n"), F.sum(F.when(F.col("core"), 1).otherwise(0)).alias("cores"))

    def measure(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        asked, n = (table.column(c).to_numpy() for c in ("cores", "n"))
        k = np.nan_to_num(table.column("min_points").to_numpy(), nan=0).astype(np.int64) - 1
        # one row a position and min_points; positions are distinct, points of either kind count
        place, row = np.unique(np.stack((x, y)), axis=1, return_inverse=True)
        row = row.ravel()
        use = np.flatnonzero((asked > 0) & (k > 0))
        sums, full = [np.full(1, np.nan)] * 2
        if len(use) and n.sum() > 1:
            d = near_distances(place[0], place[1], np.bincount(row, n).astype(np.int64), np.unique(row[use]), int(min(k[use].max(), n.sum() - 1)))
            upto = np.where(np.isfinite(d), d, 0).cumsum(axis=1)
            s, weight = upto[row[use], np.minimum(k[use], d.shape[1]) - 1], asked[use]
            some = s > 0
            sums = (s / k[use] * weight).sum(keepdims=True) / weight.sum()
            if some.any():
                full = (k[use][some] / s[some] * weight[some]).sum(keepdims=True) / weight[some].sum()
        out = table.slice(0, 1).select(by)
        for name, value in (("radius", sums), ("density", full)):
            out = out.append_column(name, pa.array(value, pa.float64(), from_pandas=True))
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*by).schema.fields) + ", radius double, density double"
    return own.groupBy(*by).agg(F.count("*").alias("size")).join(at.groupBy(*by).applyInArrow(measure, schema), by, "left")


def weighted_density(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, density, cover): densities of clusters (size, density, area, cells) weighted by their shares of clustered points, and hull areas by tested cells."""
    got = clusters.groupBy(*keys).agg((F.sum(F.col("density") * F.col("size")) / F.sum("size")).alias("density"), (F.sum("area") / F.max("cells")).alias("cover"))
    return got.na.fill(0.0, ["density", "cover"])
