"""Quality rules: word and line counts, and compression bands.

Base: a text of fewer than 20 words fails, and one with more than 30 % of its words in 8-word windows that occur twice or more. Bands: the zstandard
ratio (bytes by compressed bytes) of the whole text must lie between two limits that depend on its length, and at most half of its chunks may lie outside the limits of their size:
4 KiB for texts of that length or more, 512 bytes for shorter ones. Where the length is no multiple of the chunk's, the last chunk is the text's end; a text of less
than 512 bytes is its own chunk. A ratio above the band is repetitive text, one below is incompressible.

Defined cases: a null or blank text has no words, fails the base and goes. Repeated rows are judged each; other columns are ignored;
an empty table gives an empty result. Texts of any length are judged whole; the memory of a step is that of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.shared import batch_spans, lean, mix64, random_u64, span_hashes, steps

#: (bytes from, least ratio, greatest ratio) of whole texts: short ones compress little, long ones more. From 512 bytes on the least lies above base64 and random letters and digits
#: (up to 1.29 below 1 KiB, 1.37 beyond) and below prose (1.41 below 1 KiB, 1.63 beyond).
BANDS = ((0, 0.4, 2.6), (128, 0.8, 2.6), (256, 1.1, 3.0), (512, 1.32, 3.2), (1024, 1.5, 3.4), (2048, 1.5, 3.6), (4096, 1.5, 4.0), (16384, 1.5, 4.5))
#: (bytes of the text from, bytes of a chunk, least ratio, greatest ratio): prose is not below 1.38 in 512 bytes, base64 and random letters and digits not above 1.29.
CHUNKS = ((512, 512, 1.32, 3.0), (4096, 4096, 1.5, 4.0))
CHUNK_SHARE = 0.5
LEVEL = 3
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8

_SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, ratio double, chunks bigint, bad_chunks bigint"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in "#*$%&|<>"]] = True
_BLANK = " \t\n\x0b\x0c\r"


def repeat_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    factors = random_u64(window, 23) | np.uint64(1)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(window):
            h += mix64(words[j : j + n] + factors[j]) * factors[j]
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return 0
    hit = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def band(n_bytes: int) -> tuple[float, float]:
    """The limits for a text of so many bytes."""
    return next((lo, hi) for least, lo, hi in reversed(BANDS) if n_bytes >= least)


class Bands:
    """Whole and chunk ratios of texts."""

    def __init__(self) -> None:
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def judge(self, data: bytes) -> tuple[float | None, int, int, bool]:
        """(ratio, chunks, chunks outside the band, whether the text stays)."""
        if not data:
            return None, 0, 0, False
        ratio = len(data) / len(self.compressor.compress(data))
        lo, hi = band(len(data))
        size, least, most = next((x[1:] for x in reversed(CHUNKS) if len(data) >= x[0]), (len(data), lo, hi))
        starts = list(range(0, len(data) - size + 1, size))
        if len(data) % size:
            starts.append(len(data) - size)
        chunks, bad = len(starts), 0
        for i in starts:
            r = size / len(self.compressor.compress(data[i : i + size]))
            bad += not least <= r <= most
        return ratio, chunks, bad, lo <= ratio <= hi and bad <= CHUNK_SHARE * chunks


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = Bands()
    for batch in batches:
        for a, b, data, offsets in steps(batch.column(1)):
            starts, ends, first = batch_spans(data, offsets)
            words = span_hashes(data, starts, ends)
            inside = np.zeros(len(data) + 1, np.int8)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
            total = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[offsets])  # noqa: E731, B023
            n_words, chars = np.diff(first), total(inside & ((data & 0xC0) != 0x80))
            symbols = total(_SYMBOL[data])
            rows = []
            raw = data.tobytes()
            for i in range(b - a):
                text = raw[offsets[i] : offsets[i + 1]]
                n = int(n_words[i])
                repeats = repeat_words(words[first[i] : first[i + 1]])
                failed = n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n
                ratio, chunks, bad, ok = bands.judge(text)
                rows.append((n, int(chars[i]), int(symbols[i]), dup_lines(text.decode()), repeats, failed, ok and not failed, ratio, chunks, bad))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunks", "bad_chunks"],
            )


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every row of ``docs``; one pass, no shuffle."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(lean(_judge), _SCHEMA)


def keep_by_rules(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that the rules keep, in one pass."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(at)], ["doc_id", "text"])
            kept = pa.chunked_array([x.column("kept") for x in _judge(iter([pair]))], pa.bool_()).combine_chunks()
            yield batch.filter(kept)

    return docs.mapInArrow(lean(run), docs.schema)
