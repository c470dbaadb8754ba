"""Sequential steps as grouped functions: window choice, model fitting, state paths, domain calls, alignment, consensus and features.

A group is one dataset's training values (of bounded number), one gap-free region, one chromosome of one map, or one domain: never larger than a chromosome's
contacts. Models travel as a JSON column, joined by dataset.
"""

from __future__ import annotations

import json
from collections.abc import Container, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators import hierarchy as hi
from foldspark.operators import tracks
from foldspark.operators.feature import domain_feature, smooth_decay
from foldspark.operators.matrix import KEY
from foldspark.operators.sequences import SUMS, Caller, Contacts, Mixture, boundaries, choose_window, fit_mixture, next_mixture, sequence_sums, viterbi


def _pair(left: DataFrame, right: DataFrame, *by: str):
    """Both tables grouped together, with column identities of their own: they may stem from the same table."""
    one, two = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (left, right))
    return one.groupBy(*by).cogroup(two.groupBy(*by))


def model_to_json(m: Mixture) -> str:
    return json.dumps({"trans": m.trans.tolist(), "end": m.end, "weight": m.weight.tolist(), "mean": m.mean.tolist(), "sd": m.sd.tolist()})


def model_from_json(text: str) -> Mixture:
    x = json.loads(text)
    return Mixture(np.array(x["trans"]), float(x["end"]), *(np.array(x[k]) for k in ("weight", "mean", "sd")))


def adaptive_windows(pixels: DataFrame, bins: DataFrame, default: int, min_bins: int = 5) -> DataFrame:
    """(bin, w): the window of every bin, chosen from its up-minus-down values, which come as one row a bin: the offsets with contacts and their values."""
    names = [*KEY, "bin", "w"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = []
            for near in batch.column(3):
                p = np.zeros(max(0, default - 2))
                if near.is_valid:
                    d, value = (near.values.field(k).to_numpy() for k in (0, 1))
                    p[d - 2] = value
                windows.append(choose_window(p, default, min_bins))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(windows, pa.int64())], names)

    near = tracks.arms(pixels, default).groupBy(*KEY, "bin").agg(F.collect_list(F.struct("d", (F.col("up") - F.col("down")).alias("p"))).alias("near"))
    # at most ``default`` offsets a bin
    rows = bins.select(*KEY, "bin").join(near, [*KEY, "bin"], "left").select(*KEY, "bin", "near")
    return rows.mapInArrow(choose, "dataset string, chrom string, bin bigint, w bigint")


#: Training values of a dataset that one task fits; a larger dataset is fitted by all tasks, a job a round.
TOGETHER = 5_000_000


def fit_models(sequences: DataFrame, rounds: int = 10_000, stop: float = 1e-5, together: int = TOGETHER) -> DataFrame:
    """(dataset, model, steps, loglik): one model a dataset from its training sequences (chrom, start_bin, seq).

    Datasets of up to ``together`` values are fitted by a task each; of larger ones every sequence gives its sums, which are added up by an aggregate, and the
    driver makes the next model from them, until every model gains less than ``stop``. Where no sequence fits, the start model stays and loglik is null.
    """
    if together <= 0:
        return _fit_by_rounds(sequences, rounds, stop)
    size = sequences.groupBy("dataset").agg(F.sum(F.size("seq")).alias("k"))
    large = [r[0] for r in size.where(F.col("k") > together).select("dataset").collect()]
    if large:
        some = F.col("dataset").isin(large)
        return _fit_by_rounds(sequences.where(some), rounds, stop).unionByName(fit_models(sequences.where(~some), rounds, stop, 2**62))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chrom", "start_bin"])
        model, seen = fit_mixture([np.asarray(s, float) for s in pdf["seq"]], rounds=rounds, stop=stop)
        return pd.DataFrame([(pdf["dataset"].iloc[0], model_to_json(model), len(seen), seen[-1] if seen else float("nan"))], columns=["dataset", "model", "steps", "loglik"])

    return sequences.select("dataset", "chrom", "start_bin", "seq").groupBy("dataset").applyInPandas(fit, "dataset string, model string, steps bigint, loglik double")


def _fit_by_rounds(sequences: DataFrame, rounds: int, stop: float) -> DataFrame:
    spark, schema = sequences.sparkSession, "dataset string, model string, steps bigint, loglik double"
    rows = sequences.select("dataset", "seq").where("size(seq) >= 4")
    models = {r[0]: Mixture.initial() for r in sequences.select("dataset").distinct().collect()}
    seen: dict[str, list[float]] = {k: [] for k in models}
    open_ = set(models)
    sums = ", ".join(f"s{i} double" for i in range(SUMS))
    for _ in range(rounds):
        table = {k: model_to_json(models[k]) for k in sorted(open_)}

        def expect(batches: Iterator[pd.DataFrame], table: dict[str, str] = table) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = [(d, *sequence_sums(model_from_json(table[d]), np.asarray(s, float))) for d, s in zip(pdf["dataset"], pdf["seq"], strict=True)]
                yield pd.DataFrame(out, columns=["dataset", *(f"s{i}" for i in range(SUMS))])

        got = rows.where(F.col("dataset").isin(sorted(open_))).mapInPandas(expect, f"dataset string, {sums}")
        total = {r[0]: np.array(r[1:]) for r in got.groupBy("dataset").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(SUMS)]).collect()}
        for k in sorted(open_):
            if k not in total or not total[k][1]:  # no path fits any sequence
                open_.discard(k)
                continue
            seen[k].append(float(total[k][0]))
            if len(seen[k]) > 1 and seen[k][-1] - seen[k][-2] < stop:
                open_.discard(k)
            else:
                models[k] = next_mixture(models[k], total[k])
        if not open_:
            break
    return spark.createDataFrame([(k, model_to_json(m), len(seen[k]), seen[k][-1] if seen[k] else None) for k, m in sorted(models.items())], schema)


def state_paths(values: DataFrame, models: DataFrame) -> DataFrame:
    """(start_bin, bin, state): the likeliest states of every region of ``values`` (start_bin, bin, di)."""

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        states = viterbi(model_from_json(pdf["model"].iloc[0]), pdf["di"].to_numpy())
        out = pdf[["dataset", "chrom", "start_bin", "bin"]].iloc[: len(states)].copy()
        out["state"] = states
        return out

    rows = values.select(*KEY, "start_bin", "bin", "di").join(models.select("dataset", "model"), "dataset")
    return rows.groupBy(*KEY, "start_bin").applyInPandas(path, "dataset string, chrom string, start_bin bigint, bin bigint, state bigint")


def bottom_domains(values: DataFrame, models: DataFrame, min_bins: int = 5) -> DataFrame:
    """(start_bin, domain_start, domain_end): bottom domains of every region, in bins."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        first, ends = int(pdf["bin"].iloc[0]), boundaries(viterbi(model_from_json(pdf["model"].iloc[0]), pdf["di"].to_numpy()))
        rows = [(pdf["dataset"].iloc[0], pdf["chrom"].iloc[0], pdf["start_bin"].iloc[0], a + first, b + first) for a, b in zip(ends, ends[1:], strict=False) if b - a >= min_bins]
        return pd.DataFrame(rows, columns=["dataset", "chrom", "start_bin", "domain_start", "domain_end"])

    rows = values.select(*KEY, "start_bin", "bin", "di").join(models.select("dataset", "model"), "dataset")
    return rows.groupBy(*KEY, "start_bin").applyInPandas(cut, "dataset string, chrom string, start_bin bigint, domain_start bigint, domain_end bigint")


_CALLS = "dataset string, chrom string, kind string, start bigint, end bigint, noise double, level bigint, value double"


def call_domains(pixels: DataFrame, sizes: DataFrame, models: DataFrame, res: int, *, hierarchical: bool, longest: int = 4_000_000, windows: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Everything that a chromosome's call gives, by ``kind``: ``domain`` (noise, level), ``gap`` bins and ``di`` values (value), positions in base pairs.

    ``sizes``: (dataset, chrom, n); ``windows``: :func:`adaptive_windows` and the default they were chosen with, chosen again where they are not given or a chromosome is too short for that default. The single-level caller gives bottom domains; the hierarchical one gives TADs, their nested domains, and ends moved to the least insulation.
    """

    default = windows[1] if windows else -1

    def call(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["dataset", "chrom", "kind", "start", "end", "noise", "level", "value"]
        if right.empty:
            return pd.DataFrame([], columns=columns)
        dataset, chrom, n, model = right[["dataset", "chrom", "n", "model"]].iloc[0]
        contacts = Contacts(int(n), left["bin1"].to_numpy(), left["bin2"].to_numpy(), left["v"].to_numpy())
        caller = Caller(contacts, res, model_from_json(model), longest, 5 if hierarchical else 10, 0.0 if hierarchical else 1.0)
        chosen = right["windows"].iloc[0]
        caller.start(np.asarray(chosen, np.int64) if chosen is not None and caller.default == default else None)
        found = caller.iterate(lambda a, b: hi.mismatch(a, b, res))
        if hierarchical:
            rows = [("domain", s, e, noise, level, None) for s, e, noise, level in caller.hierarchy(found)]
        else:
            rows = [("domain", s, e, noise, 0, None) for r in sorted(found) for s, e, noise in found[r]]
        outside = np.ones(contacts.n, bool)
        for s, e in caller.regions:
            outside[s:e] = False
        rows += [("gap", int(b) * res, (int(b) + 1) * res, None, None, None) for b in np.flatnonzero(outside)]
        rows += [("di", b * res, (b + 1) * res, None, None, float(x)) for b, x in enumerate(caller.index)]
        return pd.DataFrame([(dataset, chrom, *r) for r in rows], columns=columns).astype({"start": "int64", "end": "int64", "level": "Int64", "noise": "float64", "value": "float64"})

    meta = sizes.select(*KEY, "n").join(models.select("dataset", "model"), "dataset")
    if windows is None:
        meta = meta.withColumn("windows", F.lit(None).cast("array<bigint>"))
    else:  # a number a bin of the chromosome
        chosen = windows[0].groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("bin", "w"))).alias("w")).select(*KEY, F.col("w.w").alias("windows"))
        meta = meta.join(chosen, KEY, "left")
    cells = pixels.select(*KEY, "bin1", "bin2", "v")
    return _pair(cells, meta, *KEY).applyInPandas(call, _CALLS)


def _domain_list(pdf: pd.DataFrame) -> list[tuple[int, int, int]]:
    return [(int(s), int(e), int(v)) for s, e, v in zip(pdf["start"], pdf["end"], pdf["level"], strict=True)]


_LIST = "array<struct<start:bigint,end:bigint,level:bigint>>"
_PAIRS = f"chrom string, kind string, level bigint, t_start bigint, t_end bigint, q_start bigint, q_end bigint, targets {_LIST}, queries {_LIST}, pos bigint, q_pos bigint"
_PAIR_COLUMNS = ["chrom", "kind", "level", "t_start", "t_end", "q_start", "q_end", "targets", "queries", "pos", "q_pos"]


def align_sets(target: DataFrame, query: DataFrame, res: int, kinds: Container[str] | None = None) -> DataFrame:
    """Alignment of two hierarchical sets (chrom, start, end, level), chromosome by chromosome; with ``kinds`` only rows of those are made.

    kind ``pair`` (level null: outermost regions; else nested ones) with both domain lists; ``conserved``, ``inner_changed``, ``merged``, ``split`` region pairs; and
    ``conserved_tad``, ``conserved_sub``, ``tad_to_sub``, ``sub_to_tad``, ``disappeared_tad``, ``disappeared_sub`` boundaries (pos, q_pos).
    """
    one, two = (d.select("chrom", "start", "end", "level") for d in (target, query))
    return _pair(one, two, "chrom").applyInPandas(lambda left, right: _aligned(left, right, res, kinds), _PAIRS)


def _aligned(left: pd.DataFrame, right: pd.DataFrame, res: int, kinds: Container[str] | None) -> pd.DataFrame:
    """The alignment of one chromosome of two sets."""
    t, q = hi.DomainSet(_domain_list(left), res), hi.DomainSet(_domain_list(right), res)
    return _alignment_rows((left if len(left) else right)["chrom"].iloc[0], *hi.align(t, q), t, q, kinds)


def _alignment_rows(chrom: str, there: hi.Alignment, back: hi.Alignment, t: hi.DomainSet, q: hi.DomainSet, kinds: Container[str] | None = None) -> pd.DataFrame:
    rows = []
    wanted = lambda kind: kinds is None or kind in kinds
    as_list = lambda ds: [{"start": s, "end": e, "level": v} for s, e, v in ds]
    put = lambda kind, level, k, m: rows.append((chrom, kind, level, *k[0], *k[1], as_list(m.targets), as_list(m.queries), None, None))
    if wanted("pair"):
        for k, m in there.outer.items():
            put("pair", None, k, m)
        for (_, level, k), m in sorted(there.inner.items(), key=lambda x: x[0]):
            put("pair", level, k, m)
    for kind, keys in (("conserved", hi.conserved), ("inner_changed", hi.inner_changed), ("merged", lambda *x: hi.merged(x[0]))):
        for k in sorted(keys(there, back, t, q)) if wanted(kind) else ():
            put(kind, None, k, there.outer[k])
    for k, m in sorted(hi.merged(back).items()) if wanted("split") else ():
        put("split", None, k[::-1], m.flipped())
    if t.domains and any(map(wanted, (*hi.CLASSES.values(), "disappeared_tad", "disappeared_sub"))):
        rows += [(chrom, c, None, None, None, None, None, [], [], p, x) for c, p, x in hi.boundary_classes(there, t, q) if wanted(c)]
    out = pd.DataFrame(rows, columns=_PAIR_COLUMNS)
    return out.astype({c: "Int64" for c in ("level", "t_start", "t_end", "q_start", "q_end", "pos", "q_pos")})


def align_all(domains: DataFrame, res: int) -> DataFrame:
    """:func:`align_sets` for every ordered pair of set_ids in ``domains``: columns tn and qn name the sets. One plan, a group for each pair and chromosome, whose alignment gives both orders."""
    names = sorted(r[0] for r in domains.select("set_id").distinct().collect())
    if len(names) < 2:
        raise ValueError("two sets at least are needed")
    others = F.explode(F.array(*map(F.lit, names)))
    rows = domains.select("set_id", "chrom", "start", "end", "level")
    target = rows.select(F.col("set_id").alias("tn"), others.alias("qn"), "chrom", "start", "end", "level").where("tn < qn")
    query = rows.select(others.alias("tn"), F.col("set_id").alias("qn"), "chrom", "start", "end", "level").where("tn < qn")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tn, qn, chrom = (left if len(left) else right)[["tn", "qn", "chrom"]].iloc[0]
        t, q = hi.DomainSet(_domain_list(left), res), hi.DomainSet(_domain_list(right), res)
        there, back = hi.align(t, q)
        both = (tn, qn, there, back, t, q), (qn, tn, back, there, q, t)
        return pd.concat([_alignment_rows(chrom, *x[2:]).assign(tn=x[0], qn=x[1]) for x in both])[["tn", "qn", *_PAIR_COLUMNS]]

    return _pair(target, query, "tn", "qn", "chrom").applyInPandas(run, f"tn string, qn string, {_PAIRS}")


def consensus(domains: DataFrame, gaps: DataFrame, res: int) -> DataFrame:
    """(chrom, start, end, level): what all replicates (set_id) of ``domains`` share; ``gaps``: (chrom, pos), the gap bins of any of them."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame([], columns=["chrom", "start", "end", "level"])
        reps = {str(k): _domain_list(v) for k, v in left.groupby("set_id")}
        got = hi.consensus(reps, set(right["pos"].astype(int)), res)
        return pd.DataFrame([(left["chrom"].iloc[0], *d) for d in got], columns=["chrom", "start", "end", "level"])

    one, two = domains.select("set_id", "chrom", "start", "end", "level"), gaps.select("chrom", "pos").distinct()
    return _pair(one, two, "chrom").applyInPandas(run, "chrom string, start bigint, end bigint, level bigint")


def domain_features(pixels: DataFrame, domains: DataFrame, res: int, *, pw: int = 2, ww: int = 5, top: float = 0.7, ratio: float = 0.05, gap: float = 0.2) -> DataFrame:
    """``domains`` (dataset, chrom, start, end; base pairs) with ap, gap_ratio, cover, n_points, n_clusters. A domain's pixels meet in one group; ap is -1 where it is not eligible."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["dataset", "chrom", "start", "end", "ap", "gap_ratio", "cover", "n_points", "n_clusters"]
        if right.empty:
            return pd.DataFrame([], columns=columns)
        dataset, chrom, start, end = right.iloc[0][["dataset", "chrom", "start", "end"]]
        lo, n = int(start) // res, -(-int(end) // res) - int(start) // res
        m = np.zeros((n, n))
        a, b = left["bin1"].to_numpy(int) - lo, left["bin2"].to_numpy(int) - lo
        m[a, b] = m[b, a] = left["v"].to_numpy(float)
        got = domain_feature(m, pw=pw, ww=ww, top=top, ratio=ratio, gap=gap)
        return pd.DataFrame([(dataset, chrom, start, end, *(got[c] for c in columns[4:]))], columns=columns)

    by = [*KEY, "start", "end"]
    own = domains.select(*by).distinct()
    rows = own.select("*", F.explode(F.sequence(F.floor(F.col("start") / res), F.ceil(F.col("end") / res) - 1)).alias("bin1"))
    cells = rows.join(pixels.select(*KEY, "bin1", "bin2", "v"), [*KEY, "bin1"]).where(F.col("bin2") < F.ceil(F.col("end") / res)).select(*by, "bin1", "bin2", "v")
    schema = "dataset string, chrom string, start bigint, end bigint, ap double, gap_ratio double, cover double, n_points bigint, n_clusters bigint"
    return _pair(cells, own, *by).applyInPandas(run, schema)


def segment_runs(domains: DataFrame, scores: DataFrame, res: int, longest: int = 4_000_000) -> DataFrame:
    """(region, start, end, members): the best partition of each region's bottom domains (region, start, end) by ``scores`` (region, start, end, score)."""
    from foldspark.operators.sequences import best_runs

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["dataset", "chrom", "region", "start", "end", "members"]
        if left.empty:
            return pd.DataFrame([], columns=columns)
        head = tuple(left.iloc[0][["dataset", "chrom", "region"]])
        spans = sorted((int(s), int(e)) for s, e in zip(left["start"], left["end"], strict=True))
        table = {(int(s), int(e)): float(x) for s, e, x in zip(right["start"], right["end"], right["score"], strict=True)}
        return pd.DataFrame([(*head, spans[a][0], spans[b][1], b - a + 1) for a, b in best_runs(spans, table, res, longest)], columns=columns)

    by = [*KEY, "region"]
    one, two = domains.select(*by, "start", "end"), scores.select(*by, "start", "end", "score")
    return _pair(one, two, *by).applyInPandas(run, "dataset string, chrom string, region bigint, start bigint, end bigint, members bigint")


def decay_fit(decay: DataFrame) -> DataFrame:
    """``decay`` (dataset, chrom, d, mean_v) with ``fit``, the smoothed decay from the first distance with a positive mean on; a group is a chromosome's distances."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        y = pdf["mean_v"].to_numpy(float)
        first = int(np.argmax(y > 0)) if (y > 0).any() else 0
        out = np.full(len(y), np.nan)
        out[first:] = smooth_decay(np.arange(first, len(y)), y[first:])
        return pdf.assign(fit=out)

    rows = decay.select(*KEY, "d", "mean_v")
    return rows.groupBy(*KEY).applyInPandas(fit, "dataset string, chrom string, d bigint, mean_v double, fit double")
