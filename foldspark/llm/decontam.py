"""Benchmark decontamination: a BM25 inverted index of the test items, queried with every training passage by block-max WAND.

Items are cut into segments of at most ``SEGMENT`` words; these are the documents of the index. A text is cut into windows of twice that many words,
one beginning at every ``SEGMENT``-th word, so every run of up to ``SEGMENT`` words lies within one window. A window's distinct words are the query. A posting
holds a word's BM25 share of its segment's self-score (the score of the segment's own words), so one threshold fits all segments. Every word has its
greatest share (its list maximum) and, sparsely, its greatest share in each block of ``BLOCK`` segments it occurs in.

Search: a window whose list maxima do not sum to the threshold has no pivot and is passed over; of the others, a block is live whose block maxima sum to it (both
tests for many windows at once). In live blocks a cursor for each word walks its postings: cursors in order of their segment, the pivot is the first segment at
which the maxima seen so far reach the threshold, cursors before it skip to it, and it is scored once all of them stand on it. All segments that reach the
threshold are returned. A candidate item is then verified: enough of the word pairs of its question must be in the text around the window, and enough of those of its answer
there or, as an answer may stand far behind its question, anywhere in the text. The answer is what follows an answer mark, else the last sentence, else the last quarter.

The index is built by Spark in shards of about ``SHARD`` words, written to the shared folder and read by the workers: texts are scanned once, whatever the number of
shards, and the driver holds the shards' names only. Document frequencies cover all items. A worker keeps ``CACHE`` bytes of shards; beyond that it reads them again for every
``FAR_GROUP`` characters of text. Windows are searched in groups of bounded size, so a text of any length costs its own size, its word numbers (4 bytes a word) and, if it
holds a candidate, the sorted pairs of these.

Defined cases: null or empty texts and items never match. An item with a null item_id is an item like any other, reported with a null item_id; several of them that match one
doc_id are one row. An item of one word matches by that word. Repeated rows are judged each; pairs of a doc_id and an item are returned once, with their best score. Other columns
are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import io
import math
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm import files
from foldspark.llm.shared import Scratch, lean

SEGMENT = 64
BLOCK = 8
#: Words of the items of one shard, about.
SHARD = 1_000_000
#: Bytes of shards that a worker keeps, and characters of texts that meet the shards together: few where all shards are kept, more where they are read again.
CACHE, GROUP, FAR_GROUP = 1 << 28, 1 << 21, 1 << 24
#: Shards that a worker can keep, about.
NEAR = 3
#: Characters (or words) that are worked on at once, and (window, block) cells that are summed at once.
STRETCH, CELLS = 1 << 18, 1 << 19
K1, B = 1.2, 0.75
#: Share of a segment's self-score that makes it a candidate.
THRESHOLD = 0.6
#: Shares of the question's and of the answer's word pairs that must be found.
QUESTION, ANSWER = 0.7, 0.7
_WORD = re.compile(r"\w+")
_BREAK = re.compile(r"\W")
_MARK = re.compile(r"(?im)^\s*(?:answer|a)\s*:")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer."""
    mark = _MARK.search(text)
    if mark:
        q, a = words(text[: mark.start()]), words(text[mark.end() :])
        if q and a:
            return q, a
    ends = [m.end() for m in re.finditer(r"[.!?]+\s+", text.rstrip())]
    if ends:
        q, a = words(text[: ends[-1]]), words(text[ends[-1] :])
        if q and len(a) >= 3:
            return q, a
    w = words(text)
    cut = len(w) - max(1, len(w) // 4)
    return w[:cut], w[cut:]


def pair_codes(ids: np.ndarray, size: int) -> np.ndarray:
    """Codes of neighbouring words (ids below ``size``, -1 for others, which pair with nothing) and of lone words."""
    known = (ids[:-1] >= 0) & (ids[1:] >= 0)
    pairs = ids[:-1][known].astype(np.int64) * size + ids[1:][known]
    return np.concatenate((pairs, -1 - ids[ids >= 0].astype(np.int64)))


def _wanted(ids: np.ndarray, size: int) -> np.ndarray:
    """The distinct pairs of a part of an item; a lone word stands for itself."""
    codes = pair_codes(ids, size)
    return np.unique(codes[codes >= 0] if len(ids) > 1 else codes)


def _ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (n[0] of them), begin[1], ..."""
    return np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))


class Index:
    """One shard: arrays by word (postings, list maxima, block maxima) and by item (question and answer pairs)."""

    ARRAYS = ("post", "seg", "share", "most", "cell", "block", "peak", "owner", "item", "named", "size", "q", "qs", "a", "as_")

    def __init__(self, vocabulary: list[str], arrays: dict[str, np.ndarray]):
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])
        self.blocks = -(-len(self.owner) // BLOCK)
        self.bytes = sum(x.nbytes for x in arrays.values()) + 120 * len(vocabulary)
        # plain sequences for the cursors
        self._seg, self._share, self._post = memoryview(self.seg), memoryview(self.share), memoryview(self.post)

    @classmethod
    def build(cls, items: list[tuple[int | None, str]], df: dict[str, int], n: int, mean: float) -> Index:
        """``df``, ``n`` and ``mean`` (words a segment) are of all segments, also of those in other shards."""
        ids: dict[str, int] = {}
        entries: list[tuple[int, int, float]] = []
        owner, item, size, parts = [], [], [], []
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            w = words(text)
            if not w:
                continue
            at = np.array([ids.setdefault(t, len(ids)) for t in w], np.int32)
            head, tail = question_answer(text)
            parts.append([np.array([ids[t] for t in p], np.int32) for p in (head, tail)])
            for lo in range(0, len(w), SEGMENT):
                word, tf = np.unique(at[lo : lo + SEGMENT], return_counts=True)
                length = min(SEGMENT, len(w) - lo)
                often = np.array([df[w[lo + int(np.argmax(at[lo : lo + SEGMENT] == k))]] for k in word], float)
                score = np.log(1 + (n - often + 0.5) / (often + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                share = score / math.fsum(score)
                entries += zip(word.tolist(), [len(owner)] * len(word), share.tolist(), strict=True)
                owner.append(len(item))
            item.append(item_id)
            size.append(len(w))
        entries.sort()
        word, seg, share = (np.array(x, t) for x, t in zip(zip(*entries, strict=True) if entries else ([], [], []), (np.int64, np.int32, np.float64), strict=True))
        post = np.searchsorted(word, np.arange(len(ids) + 1))
        key = word * (len(owner) // BLOCK + 1) + seg // BLOCK
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        peak = np.maximum.reduceat(share, first) if len(first) else share
        wanted = [[_wanted(p[k], len(ids)) for p in parts] for k in (0, 1)]
        ends = lambda xs: np.cumsum([0, *map(len, xs)]).astype(np.int64)
        join = lambda xs: np.concatenate([np.empty(0, np.int64), *xs])
        return cls(
            list(ids),
            {
                "post": post.astype(np.int64), "seg": seg, "share": share, "most": np.maximum.reduceat(share, post[:-1]) if len(ids) else share,
                "cell": np.searchsorted(word[first], np.arange(len(ids) + 1)).astype(np.int64), "block": (seg[first] // BLOCK).astype(np.int32), "peak": peak,
                "owner": np.array(owner, np.int32), "item": np.array([x or 0 for x in item], np.int64), "named": np.array([x is not None for x in item], bool),
                "size": np.array(size, np.int64), "q": join(wanted[0]), "qs": ends(wanted[0]), "a": join(wanted[1]), "as_": ends(wanted[1]),
            },
        )

    def write(self, uri: str) -> None:
        out = io.BytesIO()
        np.savez(out, words=np.frombuffer("\n".join(self.ids).encode(), np.uint8), **{k: getattr(self, k) for k in self.ARRAYS})
        with files.create(uri) as f:
            f.write(out.getvalue())

    @classmethod
    def read(cls, uri: str) -> Index:
        with files.read(uri) as f:
            got = np.load(io.BytesIO(f.read()))
        text = got["words"].tobytes().decode()
        return cls(text.split("\n") if text else [], {k: got[k] for k in cls.ARRAYS})

    def live(self, window: np.ndarray, word: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, int]]:
        """(window, its words, block) where the block maxima sum to the threshold; ``window`` ascends."""
        begin = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
        size = np.diff(np.concatenate((begin, [len(word)])))
        able = np.add.reduceat(self.most[word], begin) >= threshold
        begin, size = begin[able], size[able]
        step = max(1, CELLS // max(1, self.blocks))
        for lo in range(0, len(begin), step):
            b, s = begin[lo : lo + step], size[lo : lo + step]
            own = np.repeat(np.arange(len(b)), s)
            w = word[_ragged(b, s)]
            # cells of the words, in slices of bounded size
            sums = np.zeros(len(b) * self.blocks)
            count = self.cell[w + 1] - self.cell[w]
            total = np.cumsum(count)
            at = 0
            while at < len(w):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CELLS, "right")))
                cells = _ragged(self.cell[w[at:end]], count[at:end])
                sums += np.bincount(np.repeat(own[at:end], count[at:end]) * self.blocks + self.block[cells], self.peak[cells], len(sums))
                at = end
            for hit in np.flatnonzero(sums >= threshold).tolist():
                i, block = divmod(hit, self.blocks)
                yield int(window[b[i]]), word[b[i] : b[i] + s[i]], block

    def search(self, window: np.ndarray, word: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """All (window, segment, share) of at least ``threshold``; ``window`` ascends, ``word`` has each window's distinct word ids."""
        if not len(word):
            return []
        out = []
        for k, own, block in self.live(window, word, threshold - 1e-6):
            out += [(k, seg, x) for seg, x in self._walk(own, block, threshold - 1e-9)]
        return out

    def _walk(self, own: np.ndarray, block: int, threshold: float) -> Iterator[tuple[int, float]]:
        """WAND over the postings of one block: (segment, share) of at least ``threshold``."""
        lo, hi = block * BLOCK, (block + 1) * BLOCK
        seg, share, post = self._seg, self._share, self._post
        cursors = []  # [segment, position, end, block maximum]
        for k in own.tolist():
            at = bisect_left(seg, lo, post[k], post[k + 1])
            end = bisect_left(seg, hi, at, post[k + 1])
            if at < end:
                cursors.append([seg[at], at, end, max(share[at:end])])
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= threshold - 1e-6:
                    pivot = c[0]
                    break
            if pivot is None:
                return
            if cursors[0][0] == pivot:
                score, moved = 0.0, 0
                for c in cursors:
                    if c[0] != pivot:
                        break
                    score += share[c[1]]
                    moved += 1
                if score >= threshold:
                    yield pivot, score
                target = pivot + 1
            else:
                moved, target = sum(c[0] < pivot for c in cursors), pivot
            for c in cursors[:moved]:
                c[1] = bisect_left(seg, target, c[1], c[2])
                c[0] = seg[c[1]] if c[1] < c[2] else hi
            if any(c[0] >= hi for c in cursors[:moved]):
                cursors = [c for c in cursors if c[0] < hi]


class Texts:
    """The words of a group of texts, numbered once for all shards."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        parts, self.begin = [], [0]
        for text in texts:
            text = text.lower()
            n = at = 0
            while at < len(text):
                end = len(text)
                if end - at > STRETCH:
                    stop = _BREAK.search(text, at + STRETCH)
                    end = stop.start() if stop else end
                w = _WORD.findall(text, at, end)
                parts.append(np.array([number.setdefault(t, len(number)) for t in w], np.int32))
                n, at = n + len(w), end
            self.begin.append(self.begin[-1] + n)
        self.codes = np.concatenate([np.empty(0, np.int32), *parts])
        self.words = number

    def match(self, index: Index, threshold: float = THRESHOLD) -> Iterator[tuple[int, int | None, float, float, float]]:
        """(text, item id, score, question share, answer share) of the verified candidates."""
        own = np.array([index.ids.get(w, -1) for w in self.words], np.int32)
        ids = own[self.codes] if len(own) else self.codes
        begin = np.array(self.begin)
        n = np.diff(begin)
        # windows of all texts, numbered through: the last part of a text has no window of its own unless it is the only one
        windows = np.maximum(1, -(-n // SEGMENT) - 1)
        first = np.concatenate(([0], np.cumsum(windows)))
        size = len(index.ids)
        step = STRETCH // SEGMENT
        text_of = lambda w: int(np.searchsorted(first, w, "right")) - 1
        for lo in range(0, int(first[-1]), step):
            hi = min(lo + step, int(first[-1]))
            t, last = text_of(lo), text_of(hi - 1)
            start = begin[t] + (lo - first[t]) * SEGMENT
            stop = min(begin[last + 1], begin[last] + (hi + 1 - first[last]) * SEGMENT)
            at = start + np.flatnonzero(ids[start:stop] >= 0)
            text = np.searchsorted(begin, at, "right") - 1
            part = (at - begin[text]) // SEGMENT
            both = np.concatenate((first[text] + np.maximum(part - 1, 0), first[text] + np.minimum(part, windows[text] - 1)))
            mine = (both >= lo) & (both < hi)
            cell = both[mine] * size + np.concatenate((ids[at], ids[at]))[mine]
            cell.sort()
            cell = cell[np.concatenate((np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1]))]
            whole: tuple[int, np.ndarray] | None = None
            for w, seg, score in index.search(cell // size, cell % size, threshold):
                t = text_of(w)
                it = int(index.owner[seg])
                body = ids[begin[t] : begin[t + 1]]
                start = (w - int(first[t])) * SEGMENT
                near = pair_codes(body[max(0, start - index.size[it]) : start + 2 * SEGMENT + index.size[it]], size)
                q, a_ = index.q[index.qs[it] : index.qs[it + 1]], index.a[index.as_[it] : index.as_[it + 1]]
                qs = float(np.isin(q, near).mean()) if len(q) else 1.0
                if qs < QUESTION:
                    continue
                share = float(np.isin(a_, near).mean()) if len(a_) else 1.0
                if share < ANSWER:
                    if whole is None or whole[0] != t:
                        whole = t, np.unique(pair_codes(body, size))
                    share = float(np.isin(a_, whole[1], assume_unique=True).mean())
                if share >= ANSWER:
                    yield t, int(index.item[it]) if index.named[it] else None, score, qs, share


def write_index(items: DataFrame, scratch: Scratch, *, shard: int = SHARD) -> list[str]:
    """The index of ``items`` (item_id, text) as files of about ``shard`` words each: their names."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                word, size = [], []
                for lo in range(0, len(w), SEGMENT):
                    part = w[lo : lo + SEGMENT]
                    word += [None, *dict.fromkeys(part)]
                    size += [len(part), *[0] * len(set(part))]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(word), pa.int64()), pa.array(word, pa.string()), pa.array(size, pa.int64())], ["key", "word", "size"])

    # a row for each segment (word null, its size) and for each distinct word of it
    keyed = rows.select(F.xxhash64("item_id", "text").alias("key"), "item_id", "text")
    stats = scratch.table(keyed.select("key", "text").mapInArrow(lean(cut), "key bigint, word string, size bigint"), "words")
    n, total = stats.where("word is null").agg(F.count("*"), F.sum("size")).first()
    if not n:
        return []
    parts, mean, folder = math.ceil(total / shard), total / n, scratch.path("index")
    of = F.pmod("key", F.lit(parts)).alias("shard")
    df = stats.where("word is not null").groupBy("word").agg(F.count("*").alias("df"))
    df = stats.where("word is not null").select(of, "word").distinct().join(df, "word").select("shard", "word", "df")

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        often = dict(zip(right.column("word").to_pylist(), right.column("df").to_pylist(), strict=True))
        uri = f"{folder}/{uuid.uuid4().hex}.npz"
        Index.build(list(zip(left.column("item_id").to_pylist(), left.column("text").to_pylist(), strict=True)), often, n, mean).write(uri)
        return pa.table({"uri": pa.array([uri])})

    # a shard holds about ``shard`` words of items, dealt by hash
    written = keyed.select(of, "item_id", "text").groupBy("shard").cogroup(df.groupBy("shard")).applyInArrow(build, "uri string")
    uris = sorted(r["uri"] for r in scratch.table(written, "shards").collect())
    scratch.keep(folder)
    return uris


_KEPT: dict[str, Index] = {}


def _shards(uris: list[str]) -> Iterator[Index]:
    """The shards one after the other; those that fit the cache are kept."""
    for uri in uris:
        index = _KEPT.get(uri)
        if index is None:
            for old in [u for u in _KEPT if u not in uris]:
                del _KEPT[old]
            index = Index.read(uri)
            if sum(x.bytes for x in _KEPT.values()) + index.bytes <= CACHE:
                _KEPT[uri] = index
        yield index


def _groups(texts: pa.Array, shards: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``GROUP`` characters, or ``FAR_GROUP`` where there are many shards."""
    most, first, group, size = GROUP if shards <= NEAR else FAR_GROUP, 0, [], 0
    for i, x in enumerate(texts):
        text = x.as_py() or ""
        if group and size + len(text) > most:
            yield first, group
            first, group, size = i, [], 0
        group.append(text)
        size += len(text)
    if group:
        yield first, group


def contaminated(docs: DataFrame, items: DataFrame, *, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the verified items of every text; one pass over ``docs``."""
    uris = write_index(items, Scratch(docs.sparkSession, "decontam"), shard=shard)
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, group in _groups(batch.column(1), len(uris)):
                texts = Texts(group)
                rows = [(ids[at + t], *best) for index in _shards(uris) for t, *best in texts.match(index)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], names)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(lean(run), "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double")
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, *, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text holds no item; one pass, no shuffle."""
    uris = write_index(items, Scratch(docs.sparkSession, "decontam"), shard=shard)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for first, group in _groups(batch.column(at), len(uris)):
                texts = Texts(group)
                for index in _shards(uris):
                    keep[[first + t for t, *_ in texts.match(index)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
