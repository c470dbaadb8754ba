"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Indicators: words, word pairs, and runs of one to three word shapes (letters drawn together by case, digits, each punctuation mark kept). Each is
scaled by its class log-count ratio; the vectors have length one. A linear hinge-loss model is fitted by dual coordinate descent and interpolated with
its mean weight. Margins become probabilities by a logistic fit on labelled rows that the descent did not see, weighted to the label shares.

The fit reads at most ``sample`` labelled rows a class, those with the least hash of doc_id; this is the operator's only bound. Only rows whose
crc32(doc_id as text) mod 4 is not 2 are learned from. Of texts that repeat a doc_id the one with the least hash is learned. Scoring covers all rows, and a text's score is the same
whatever texts are scored beside it.

Defined cases: null and empty texts have no indicators and get the score of the bias alone. Rows without a doc_id count as not held out and are scored; a
doc_id with two labels is learned with both. With no or only one class to learn from every score is 0.5 or that class's. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.shared import _LOWER, batch_spans, lean, mix64, span_hashes, steps

BITS = 18
#: Labelled rows a class that the fit reads at most.
SAMPLE = 2000
ALPHA = 1.0
BETA = 0.5
COST = 1.0
EPOCHS = 12

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_RUN = np.isin(np.arange(256), [97, 65, 48])


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct indicator ids of every text of a run, and where each text's begin (with the end)."""
    starts, ends, first = batch_spans(data, offsets)
    words = span_hashes(_LOWER[data], starts, ends)
    kind = _CLASS[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~_RUN[kind[1:]]
    keep[starts] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    shapes = span_hashes(kind[keep], at[starts], at[ends])
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    parts, owners = [], []
    with np.errstate(over="ignore"):
        for salt, base, most in ((1, words, 2), (101, shapes, 3)):
            h = base * np.uint64(2 * salt + 1)
            parts.append(mix64(h + np.uint64(salt)))
            owners.append(doc)
            for j in range(1, most):
                h = mix64(h[:-1] + np.uint64(j)) + base[j:] * np.uint64(2 * salt + 1) if len(h) > 1 else h[:0]
                same = doc[j:] == doc[: len(doc) - j] if len(doc) > j else np.zeros(0, bool)
                parts.append(mix64(h + np.uint64(salt + j))[same])
                owners.append(doc[: len(doc) - j][same] if len(doc) > j else doc[:0])
    owner = np.concatenate(owners)
    cell = (owner.astype(np.int64) << BITS) | (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
    cell.sort()
    if len(cell):
        cell = cell[np.concatenate(([True], cell[1:] != cell[:-1]))]
    return (cell & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(cell, np.arange(len(n) + 1, dtype=np.int64) << BITS)


@dataclass
class Model:
    """``ratio``: squared log-count ratios, for the length; ``weight``: ratio times weight; the logistic turns margins into scores."""

    square: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        # a sum of its own for each text, so that a score does not depend on the texts beside it
        full = np.flatnonzero(begin[1:] > begin[:-1])
        sums = np.zeros((2, len(begin) - 1))
        for total, table in zip(sums, (self.weight, self.square), strict=True):
            if len(full):
                total[full] = np.add.reduceat(table[ids].astype(np.float64), begin[:-1][full])
        return sums[0] / np.sqrt(np.maximum(sums[1], 1e-12)) + self.bias

    def scores(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(ids, begin) + self.shift, -500, 500)))


def descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: weights and bias (a constant input of one)."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    norms = [float(v @ v) + 1 for v in values]
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            idx, v = rows[i], values[i]
            slope = y[i] * (float(w[idx] @ v) + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[idx] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by damped Newton steps; the slope is never negative."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-3 * a, (weight * (p - y)).sum()])
        s = weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - float(step[0]), b - float(step[1])
        if float(np.abs(step).max()) < 1e-8:
            break
    return max(a, 0.0), b


def fit(rows: list[np.ndarray], label: np.ndarray, calibrate: np.ndarray, share: float) -> Model:
    """The model from indicator ids, labels (0 or 1), a mask of rows kept for the logistic fit, and the share of label 1 among all labels."""
    size = 1 << BITS
    learn = np.flatnonzero(~calibrate)
    if len(set(label[learn].tolist())) < 2 or len(set(label[calibrate].tolist())) < 2:
        learn, calibrate = np.arange(len(label)), np.ones(len(label), bool)
    if len(set(label.tolist())) < 2:
        only = 0.0 if not len(label) else 30.0 * (2 * float(label[0]) - 1)
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0, only)
    count = [np.full(size, ALPHA), np.full(size, ALPHA)]
    for i in learn:
        count[int(label[i])][rows[i]] += 1
    total = [max(1, int((label[learn] == k).sum())) + 2 * ALPHA for k in (0, 1)]
    r = np.log(count[1] / total[1]) - np.log(count[0] / total[0])
    unit = lambda i: r[rows[i]] / max(1e-6, float(np.sqrt((r[rows[i]] ** 2).sum())))
    y = 2.0 * label[learn] - 1
    w, bias = descent([rows[i] for i in learn], [unit(i) for i in learn], y, size, np.full(len(learn), COST))
    seen = (count[0] + count[1]) > 2 * ALPHA
    w = (1 - BETA) * float(np.abs(w[seen]).mean() if seen.any() else 0) + BETA * w
    model = Model((r**2).astype(np.float32), (r * w).astype(np.float32), BETA * bias, 1.0, 0.0)
    cal = np.flatnonzero(calibrate)
    begin = np.concatenate(([0], np.cumsum([len(rows[i]) for i in cal])))
    x = model.margins(np.concatenate([rows[i] for i in cal]), begin)
    t = label[cal].astype(float)
    weight = np.where(t == 1, share / max(1.0, t.sum()), (1 - share) / max(1.0, (1 - t).sum())) * len(cal)
    model.slope, model.shift = _logistic(x, t, weight)
    return model


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in steps(batch.column(0)):
            ids, begin = indicators(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([lists, *(batch.column(k).slice(a, b - a) for k in (1, 2))], ["ids", "label", "fold"])


def _fold(column: str):
    return F.crc32(F.col(column).cast("string")) % 4


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Fit on ``labels`` (doc_id, quality) and the texts of ``docs``."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & (_fold("doc_id") != 2)
    )
    known = known.distinct()
    ones, rows = known.agg(F.sum("label"), F.count("*")).first()
    hashed = known.withColumn("h", F.xxhash64("doc_id"))
    drawn = hashed.where("label = 0").orderBy("h", "doc_id").limit(sample).unionByName(hashed.where("label = 1").orderBy("h", "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 2 x sample ids: safe to broadcast
    chosen = texts.join(F.broadcast(drawn.select("doc_id", "label")), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    chosen = chosen.select("text", "label", _fold("doc_id").cast("int").alias("fold"))
    table = chosen.mapInArrow(lean(_rows), "ids array<int>, label int, fold int").toArrow()
    ids = [np.asarray(x.values) for x in table.column("ids")]
    order = sorted(range(len(ids)), key=lambda i: (len(ids[i]), ids[i].tobytes(), table.column("label")[i].as_py()))
    label, fold = np.asarray(table.column("label")), np.asarray(table.column("fold"))
    return fit([ids[i] for i in order], label[order], fold[order] == 1, (ones or 0) / max(1, rows))


def _score(model: Model, threshold: float, at: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(at)):
                score = model.scores(*indicators(data, offsets))
                part = batch.slice(a, b - a)
                if keep:
                    yield part.filter(pa.array(score >= threshold))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                        ["doc_id", "held_out", "score", "predicted"],
                    )

    return run


def classify(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; one pass, no shuffle."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(_fold("doc_id") == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(lean(_score(model, threshold, 2, False)), "doc_id bigint, held_out boolean, score double, predicted int")


def keep_by_quality(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (all columns) with a score of at least ``threshold``."""
    return docs.mapInArrow(lean(_score(model, threshold, docs.columns.index("text"), True)), docs.schema)
