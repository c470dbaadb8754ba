"""Language identification: interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A word is its letters in lower case between a start and an end mark; every letter and the end mark is predicted from up to ``ORDER`` - 1 symbols of
its word. A model keeps the hashes of its n-grams, sorted, with their interpolated log-probabilities, and the hashes of its contexts with their back-off weights. A text
goes to the language of least cross-entropy per predicted symbol. Whatever exceeds the language's calibrated limit is marked rejected.

The models are fitted on at most ``sample`` texts a language, those with the least hash of doc_id, for at most ``languages`` languages, the most frequent ones, and only on rows whose
crc32(doc_id as text) mod 4 is not 2. Of texts that repeat a doc_id in a language the one with the least hash is learned. A quarter of that sample (remainder 1) sets limits and score, the rest gives the counts. Prediction covers all rows and whole texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0. Rows without doc_id count as not held out, and are never learned from. Ties go to the
language first in order. With no language to learn from all rows are ``und``. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.shared import Scratch, lean, mix64, random_u64

ORDER = 4
#: Texts a language, and languages, that the fit reads at most.
SAMPLE, LANGUAGES = 800, 256
#: Share of a language's own calibration texts that its limit lets pass, and the room above.
PASS, ROOM = 0.995, 1.1
CACHE = 200_000
LONGEST = 64
_START, _END = "\x02", "\x03"
_SALT = random_u64(ORDER + 1, 29) | np.uint64(1)


def letters(token: str) -> list[str]:
    """The letter runs of a token, in lower case."""
    token = token.lower()
    return [token] if token.isalpha() else "".join([c if c.isalpha() else " " for c in token]).split()


def gram_hashes(codes: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """``out[k][i]``: hash of the k + 1 symbols that end at i (only valid where there are as many)."""
    with np.errstate(over="ignore"):
        base = codes.astype(np.uint64)
        out = [mix64(base * _SALT[0] + _SALT[1])]
        for k in range(1, order):
            h = np.zeros(len(base), np.uint64)
            h[k:] = mix64(out[-1][k:] + base[: len(base) - k] * _SALT[k])
            out.append(h)
    return out


@dataclass
class CharModel:
    """One language: sorted gram hashes with log-probabilities, sorted context hashes with log back-off weights."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    back: np.ndarray
    unseen: float


def _hash_strings(strings: list[str]) -> np.ndarray:
    """Hashes of whole strings, as :func:`gram_hashes` gives them."""
    out = np.empty(len(strings), np.uint64)
    for n in sorted({len(s) for s in strings}):
        at = [i for i, s in enumerate(strings) if len(s) == n]
        codes = np.frombuffer("".join(strings[i] for i in at).encode("utf-32-le"), "<u4")
        out[at] = gram_hashes(codes, n)[n - 1][n - 1 :: n]
    return out


def kneser_ney(counts: dict[str, int], order: int = ORDER, symbols: int | None = None) -> CharModel:
    """The model from counts of the longest grams: ``order`` symbols, or fewer where the gram begins with the start mark."""
    level: list[dict[str, int]] = [{} for _ in range(order + 1)]
    for g, n in counts.items():
        level[len(g)][g] = n
    for k in range(order - 1, 0, -1):  # continuation counts: distinct symbols before a gram
        for g in level[k + 1]:
            level[k][g[1:]] = level[k].get(g[1:], 0) + 1
    alphabet = symbols or len({g for g in level[1]} | {_END}) + 1
    prob: dict[str, float] = {"": 1.0 / alphabet}
    back: dict[str, float] = {}
    for k in range(1, order + 1):
        ones, twos = (sum(1 for n in level[k].values() if n == x) for x in (1, 2))
        discount = ones / (ones + 2 * twos) if ones else 0.5
        total: dict[str, int] = defaultdict(int)
        kinds: dict[str, int] = defaultdict(int)
        for g, n in level[k].items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        for c, n in total.items():
            back[c] = discount * kinds[c] / n
        for g, n in level[k].items():
            c = g[:-1]
            lower = prob[g[1:]] if g[1:] in prob else prob[""] * back.get("", 1.0)
            prob[g] = max(n - discount, 0.0) / total[c] + back[c] * lower
    unseen = math.log2(prob.pop("") * back.pop("", 1.0))
    grams, contexts = sorted(prob), sorted(back)
    gh, ch = _hash_strings(grams), _hash_strings(contexts)
    go, co = np.argsort(gh), np.argsort(ch)
    return CharModel(
        gh[go], np.log2([prob[grams[i]] for i in go]) if len(go) else np.empty(0), ch[co], np.log2([back[contexts[i]] for i in co]) if len(co) else np.empty(0), unseen
    )


def _lookup(keys: np.ndarray, values: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(ask), bool), np.zeros(len(ask))
    at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
    return keys[at] == ask, values[at]


def score_words(models: list[CharModel], words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(log2-probability of every word by every model, predicted symbols of every word)."""
    if not words:
        return np.zeros((0, len(models))), np.zeros(0, np.int64)
    text = "".join([_START + w + _END for w in words])
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = np.array([len(w) + 2 for w in words])
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    place = np.arange(len(codes)) - np.repeat(begin, n)
    h = gram_hashes(codes, order)
    out = np.empty((len(words), len(models)))
    for m, model in enumerate(models):
        value = np.zeros(len(codes))
        left = np.flatnonzero(place > 0)
        for k in range(order, 0, -1):
            now = left[place[left] >= k - 1]
            found, logp = _lookup(model.grams, model.logp, h[k - 1][now])
            value[now[found]] += logp[found]
            if k > 1:
                missed = now[~found]
                known, back = _lookup(model.contexts, model.back, h[k - 2][missed - 1])
                value[missed] += np.where(known, back, 0.0)
                left = np.concatenate((left[place[left] < k - 1], missed))
            else:
                value[now[~found]] += model.unseen
        out[:, m] = np.add.reduceat(value, begin)
    return out, n - 1


@dataclass
class Identifier:
    langs: list[str]
    models: list[CharModel]
    limits: list[float] = field(default_factory=list)
    sharpness: float = 8.0

    def batches(self, texts: Iterator[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(cross-entropies by language, predicted symbols) for lists of texts; words are scored once while the cache holds."""
        rows: dict[str, int] = {}
        table = np.zeros((1024, len(self.models) + 1))
        used = 0
        for group in texts:
            tokens = [t.split() for t in group]
            if used > CACHE:
                rows, used = {}, 0
            missing = list({t for doc in tokens for t in doc if t not in rows})
            if missing:
                parts = [letters(t) for t in missing]
                logs, n = score_words(self.models, [w for p in parts for w in p])
                ends = np.cumsum([0, *map(len, parts)])
                if used + len(missing) > len(table):
                    table = np.concatenate((table, np.zeros((used + len(missing), table.shape[1]))))
                own = np.zeros((len(missing), table.shape[1]))
                some = np.flatnonzero(ends[1:] > ends[:-1])
                if len(some):  # a sum of its own for each token: no score depends on the texts beside it
                    own[some] = np.add.reduceat(np.column_stack((logs, n)), ends[:-1][some], axis=0)
                table[used : used + len(missing)] = own
                rows.update(zip(missing, range(used, used + len(missing)), strict=True))
                used += len(missing)
            count = np.array([len(doc) for doc in tokens])
            at = np.fromiter((rows[t] for doc in tokens for t in doc), np.int64, int(count.sum()))
            for t in [t for t in missing if len(t) > LONGEST]:
                del rows[t]
            total = np.zeros((len(group), table.shape[1]))
            full = np.flatnonzero(count)
            if len(full):
                total[full] = np.add.reduceat(table[at], np.concatenate(([0], np.cumsum(count[full])[:-1])), axis=0)
            symbols = np.rint(total[:, -1]).astype(np.int64)
            yield -total[:, :-1] / np.maximum(symbols, 1)[:, None], symbols

    def verdicts(self, entropy: np.ndarray, symbols: np.ndarray) -> tuple[list[str], np.ndarray, list[bool]]:
        """(language, score, rejected)."""
        if not self.models:
            return ["und"] * len(symbols), np.zeros(len(symbols)), [True] * len(symbols)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(best)), best]
        score = 1 / np.exp2(-np.minimum(self.sharpness * (entropy - least[:, None]), 1000.0)).sum(axis=1)
        blank = symbols == 0
        lang = ["und" if b else self.langs[i] for b, i in zip(blank, best, strict=True)]
        return lang, np.where(blank, 0.0, score), [bool(b or e > self.limits[i]) for b, e, i in zip(blank, least, best, strict=True)]


def _fold(column: str):
    return F.crc32(F.col(column).cast("string")) % 4


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words[lang].update((text.as_py() or "").split())
    for lang, tokens in words.items():
        grams: Counter = Counter()
        for token, n in tokens.items():
            for w in letters(token):
                s = _START + w + _END
                for i in range(1, len(s)):
                    grams[s[max(0, i - ORDER + 1) : i + 1]] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"]
        )


def train(docs: DataFrame, *, sample: int = SAMPLE, languages: int = LANGUAGES) -> Identifier:
    """Fit on ``docs`` (doc_id, text, lang): the ``languages`` most frequent lang values are learned."""
    scratch = Scratch(docs.sparkSession, "langid")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang is not null and doc_id is not null").where(_fold("doc_id") != 2)
    # a share of each language's rows that holds the sample almost surely, by hash, so that what is ranked does not grow with the corpus
    sizes = rows.groupBy("lang").agg(F.count("*").alias("all")).orderBy(F.desc("all"), "lang").limit(languages)
    share = F.least(F.lit(1.0), F.lit(2.0 * sample + 200) / F.col("all"))
    draw = F.expr("(xxhash64(doc_id) & 9007199254740991L) / 9007199254740992D")
    # at most ``languages`` rows: small enough to broadcast
    near = rows.select("lang", "doc_id").join(F.broadcast(sizes), "lang").where(draw <= share).select("lang", "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id"))
    ids = near.withColumn("k", rank).where(F.col("k") <= sample).select("lang", "doc_id")
    # at most languages x sample ids
    drawn = rows.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    drawn = scratch.table(drawn.select("lang", "text", _fold("doc_id").alias("fold")), "sample")
    grams = drawn.where("fold <> 1").select("lang", "text").mapInArrow(lean(_counts), "lang string, gram string, n bigint")
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    table = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    for lang, gram, n in zip(*(table.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
        counts[lang][gram] = n
    langs = sorted(counts)
    symbols = len({c for lang in langs for g in counts[lang] for c in g}) + 1
    out = Identifier(langs, [kneser_ney(counts[lang], symbols=symbols) for lang in langs])
    own: dict[str, list[float]] = defaultdict(list)
    gaps = []
    held = drawn.where("fold = 1").select("lang", "text").mapInArrow(lean(_entropies(out)), "lang string, e array<double>, n bigint").toArrow()
    for lang, e, n in zip(held.column("lang").to_pylist(), held.column("e").to_pylist(), held.column("n").to_pylist(), strict=True):
        if n and lang in counts:
            own[lang].append(e[langs.index(lang)])
            gaps.append(np.array(e) - e[langs.index(lang)])
    out.limits = [float(np.quantile(own[x], PASS)) * ROOM if own[x] else math.inf for x in langs]
    if gaps:  # the sharpness that makes the true languages likeliest
        loss = lambda s: float(np.mean([np.log2(np.exp2(-s * g.clip(-100, 100)).sum()) for g in gaps]))
        out.sharpness = min((0.5, 1.0, 2.0, 4.0, 8.0, 16.0), key=loss)
    scratch.keep()
    return out


def _entropies(model: Identifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, n = next(model.batches(iter([[x or "" for x in batch.column(1).to_pylist()]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(e.tolist(), pa.list_(pa.float64())), pa.array(n, pa.int64())], ["lang", "e", "n"])

    return run


def _identify(model: Identifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[str]]:
            for batch in batches:
                for lo in range(0, len(batch), 256):
                    parts.append(batch.slice(lo, 256))
                    yield [x or "" for x in parts[-1].column(2).to_pylist()]

        for entropy, symbols in model.batches(texts()):
            lang, score, rejected = model.verdicts(entropy, symbols)
            part = parts.pop()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs``; one pass, no shuffle."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(_fold("doc_id") == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(lean(_identify(model)), "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")
