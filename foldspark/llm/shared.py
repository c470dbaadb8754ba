"""Scratch tables in the shared folder, and vectorised word hashing used by several operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 19

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where it is unset a folder of our own, but only on a local master: other executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="foldspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_LIVE: list[Scratch] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What operators leave in the shared folder inside this block goes at its end: their results must have been written by then."""
    before = len(_LIVE)
    yield
    for scratch in _LIVE[before:]:
        scratch.wipe()
    del _LIVE[before:]


class Scratch:
    """Tables written to the shared folder, so that a lost executor never costs more than one stage.

    ``keep`` deletes all of them but those that the result still reads; these go with the session's end.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: list[str] = []
        _LIVE.append(self)
        atexit.register(self._end)

    def path(self, name: str) -> str:
        self.n += 1
        self.paths.append(f"{self.root}/{self.n:03d}-{name}")
        return self.paths[-1]

    def table(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write ``df`` and read it back: cuts lineage, and later stages reuse the rows."""
        path = self.path(name)
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, table: DataFrame | str) -> None:
        """Delete a scratch table that nothing will read again."""
        path = table if isinstance(table, str) else getattr(table, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            self.paths = [x for x in self.paths if x != path]

    def keep(self, *tables: DataFrame | str) -> None:
        """Delete every table but ``tables``: what the result does not read."""
        kept = {t if isinstance(t, str) else t._scratch_path for t in tables}
        for path in [p for p in self.paths if p not in kept]:
            self.drop(path)

    def wipe(self) -> None:
        """Delete all tables."""
        if self.paths:
            self.drop(self.root)
            self.paths = []

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.wipe()
        except Exception:  # noqa: BLE001 - the session may be gone, and with it the way to the store
            pass


#: Keys over which the rows of a hot key are dealt in a join.
SALTS = 64


def hot_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, spread: list[str], total: int | None = None) -> DataFrame:
    """``left`` with the columns of ``right`` (one row for each ``on``), a left join. ``counts`` (on, n): rows of ``left`` by key, ``total`` their sum where it is known.

    At most a thousand keys can have more than a thousandth of all rows: their hashes are held on the driver, their rows dealt over ``SALTS`` keys by the columns ``spread``, and their
    rows of ``right`` repeated as often.
    """
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1000.0, total / 1000)
    hot = [r[0] for r in counts.where(F.col("n") > least).select(F.xxhash64(*on)).collect()] if total > least else []
    if not hot:
        return left.join(right, on, "left")
    is_hot = F.xxhash64(*on).isin(hot)
    left = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0)))
    right = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_salt"], "left").drop("_salt")


def _trim() -> None:
    """Give freed memory back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over batches, returning its memory to the system when the task ends."""

    @functools.wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser with full avalanche over uint64 (wraps on purpose)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def random_u64(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random words, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = random_u64(256, 7)
_POWER = np.empty(0, np.uint64)


def powers(n: int) -> np.ndarray:
    """1, B, B^2, ... modulo 2^64 for an odd B; grows on demand."""
    global _POWER
    if len(_POWER) < n:
        out = np.full(max(n, 1024), 0x9E3779B97F4A7C15 | 1, np.uint64)
        out[0] = 1
        _POWER = np.multiply.accumulate(out)
    return _POWER[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span; equal bytes have equal hashes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = ends - starts
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    at = np.arange(int(n.sum())) - np.repeat(first, n)
    with np.errstate(over="ignore"):
        term = _BYTE[data[np.repeat(starts, n) + at]] * powers(int(n.max()))[at]
        return mix64(np.add.reduceat(term, first) + n.astype(np.uint64))


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of a string column of about ``limit`` bytes.

    Null texts are empty. Offsets are relative to the run's bytes and have one entry more than the run has rows.
    """
    if not len(column):
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def batch_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of a run's words, and the first word's index of every text (with the total at the end).

    Words never cross from one text into the next.
    """
    starts, ends = word_spans(data)
    # a text may begin right after the last word of the one before: cut such words
    cuts = offsets[1:-1]
    if len(starts) and len(cuts):
        at = np.maximum(np.searchsorted(starts, cuts, "left") - 1, 0)
        inner = np.unique(cuts[(ends[at] > cuts) & (starts[at] < cuts)])
        if len(inner):
            starts, ends = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))
    return starts, ends, np.searchsorted(starts, offsets, "left")


def batch_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a run of texts, and the first word's index of every text. With ``lower`` A-Z count as a-z."""
    if lower:
        data = _LOWER[data]
    starts, ends, first = batch_spans(data, offsets)
    return span_hashes(data, starts, ends), first
