"""Packing by shortest-pack-first over the length histogram.

Texts become token ids, then an end id; every document is cut into pieces of ``size`` ids and a rest. The histogram of piece lengths has at most
``size`` entries, whatever the corpus. Lengths are placed longest first, each into the pack with the most room left (the shortest pack), by
counts of equal patterns and not by documents. The documents then meet their patterns by rank: the k-th piece of a length takes
the k-th place that the patterns have for it. Full pieces are sequences of their own, numbered by the row of the pieces' table; the others, at most one a document, are ranked by (length, salt),
with a salt for about every ``RANKED`` pieces of a length, so no length's pieces meet in one task. What is broadcast is a row a length, at most ``size``; the counts by (length, salt) are joined,
dealt as the pieces are already.

Defined cases: a null text is empty, and an empty document is its end id alone. Repeated rows are documents of their own; a null doc_id stays
null. Other columns are ignored. An empty table gives an empty result. A text of any length is encoded whole.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.shared import Scratch, lean
from foldspark.llm.tokens import ChunkEncoder

#: Pieces of one length that are ranked together, about.
RANKED = 256

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) that hold every length as often as ``counts`` says; none is longer than ``size``."""
    heap: list[tuple[int, int]] = []  # (-room, index of the group): the shortest packs first
    groups: list[tuple[int, list[int]]] = []
    done: list[tuple[int, list[int]]] = []

    def put(n: int, room: int, pattern: list[int]) -> None:
        if room:
            heapq.heappush(heap, (-room, len(groups)))
            groups.append((n, pattern))
        else:
            done.append((n, pattern))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if heap and -heap[0][0] >= length:
                room, at = heapq.heappop(heap)
                n, pattern = groups[at]
                used = min(n, left)
                if used < n:
                    put(n - used, -room, pattern)
                put(used, -room - length, [*pattern, length])
            else:
                # a new pack is the one with the most room until it is full: so many of this length fill each
                each = min(left, size // length)
                used = left - left % each
                put(used // each, size - each * length, [length] * each)
            left -= used
    return done + [groups[at] for _, at in sorted(heap, reverse=True)]


class Places:
    """Where the k-th piece of a length goes: (sequence, offset)."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        taken: dict[int, int] = {}
        rows, base = [], 0
        for n, lengths in patterns:
            offset = 0
            for length in lengths:
                first = taken.get(length, 0)
                rows.append((length, first, base, offset))
                taken[length] = first + n
                offset += length
            base += n
        rows.sort()
        self.length, self.first, self.base, self.offset = np.array(rows, np.int64).reshape(-1, 4).T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((rank, length))
        at = np.empty(len(length), np.int64)
        # the last row whose (length, first) is not above (length, rank)
        rows = np.lexsort((np.concatenate((np.zeros(len(self.first)), np.ones(len(rank)))), np.concatenate((self.first, rank[order])), np.concatenate((self.length, length[order]))))
        is_row = rows < len(self.first)
        last = np.maximum.accumulate(np.where(is_row, np.arange(len(rows)), -1))
        ask = np.flatnonzero(~is_row)
        at[order[rows[ask] - len(self.first)]] = rows[last[ask]]
        return self.base[at] + rank - self.first[at], self.offset[at]


def _pieces(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                ids, start, length, crc, total = [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    data = memoryview(encoder.encode(text.as_py() or "") + end)
                    n = len(data) // 4
                    for a in range(0, n, size):
                        ids.append(doc_id)
                        start.append(a)
                        length.append(min(size, n - a))
                        crc.append(zlib.crc32(data[4 * a : 4 * (a + size)]))
                        total.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (ids, start, length, crc, total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return run


def _place(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(np.asarray(batch.column("length")), np.asarray(batch.column("rank")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 1, size: int = 2048, ranked: int = RANKED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the row number tells apart rows that are alike in all else
    pieces = texts.mapInArrow(lean(_pieces(tokenizer, end_id, size)), _PIECES).withColumn("uid", F.monotonically_increasing_id())
    pieces = scratch.table(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram.pop(size, None)
    patterns = pack_histogram(histogram, size)
    places, shared = Places(patterns), sum(n for n, _ in patterns)
    salts = spark.createDataFrame([(k, 1 + n // ranked) for k, n in histogram.items()], "length bigint, salts bigint")
    rest = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("uid"), "salts"))
    counts = rest.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.table(counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "counts")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid"))
    rest = rest.withColumn("own", own).join(counts, ["length", "salt"])
    rest = rest.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("own") - 1).alias("rank"))
    rest = rest.mapInArrow(lean(_place(places)), f"{_PIECES}, sequence_id bigint, offset bigint")
    full = pieces.where(F.col("length") == size)
    return rest.unionByName(full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("uid") + shared).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
