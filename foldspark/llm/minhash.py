"""Near-duplicate groups: one-permutation MinHash, optimal densification, banded buckets, star-shaped candidate edges.

Every text's set of word shingles is hashed once. The hash's high bits choose one of K bins and the least hash of each bin is
kept (one permutation); an empty bin copies a bin chosen by a hash of (bin, attempt), the same for all texts (optimal
densification). Runs of ``rows`` bins form ``bands`` bucket keys. Texts with equal sets are one node. Within a bucket the
only candidate edges are those of a star, from one centre to the members, so m members cost m - 1 pairs. Stars alone would lose
links between members that are both unlike the centre. So where the members of a bucket are in more than one component after the
stars, the overlapping buckets' members are one family, and its members outside the family's largest component are held against
the whole family, in blocks of bounded size: two sets that reach the threshold share one of their rarest shingles (those beyond the threshold's share of the set), so an inverted index
of these gives the candidates, and pairs of components already joined in the block are passed over; a block returns a forest of links between components. Links
are confirmed on the full sets in both parts; none between members of a bucket is lost for the components. Joins by bucket, component and
set deal a key with more than a thousandth of all rows over several keys.

Defined cases: null or blank texts have n_shingles 0, are linked with nothing and stay. Nodes are sets, not ids: rows of one doc_id with unlike texts are judged apart, and a
row with a null doc_id takes part with its text; its component is that of the texts equal to or linked with it, null if none of these has an id.
Columns other than the two named ones are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.components import components
from foldspark.llm.shared import Scratch, batch_words, hot_join, lean, mix64, random_u64, steps

#: Chance that a pair exactly at the threshold shares no bucket.
MISS = 1e-7
#: Bins of a signature at most.
MOST_BINS = 256
_ATTEMPTS = 2048
#: Shingles of a block of a family at most (8 bytes each), and those from which on it is split, into at most ``SPREAD`` blocks, for the sake of more tasks.
BLOCK, SPLIT, SPREAD = 1 << 20, 1 << 14, 32


def banding(similarity: float, miss: float = MISS, most_bins: int = MOST_BINS) -> tuple[int, int]:
    """(bands, rows): the longest bands whose number keeps the chance of a miss at ``similarity`` below ``miss``."""
    for rows in range(16, 0, -1):
        hit = similarity**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(miss) / math.log1p(-hit))
        if bands * rows <= most_bins:
            return bands, rows
    raise ValueError("similarity too low for MinHash bands")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of every text of a run, and where each text's begin (with the end).

    A text of fewer than ``k`` words has its whole sequence as its only shingle; one without words has none.
    """
    words, first = batch_words(data, offsets)
    n = np.diff(first)
    factors = random_u64(k + 1, 11) | np.uint64(1)
    with np.errstate(over="ignore"):
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        begin = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
        h = np.zeros(len(at), np.uint64)
        short = np.repeat(np.where(n < k, n, k), count)
        for j in range(k):
            inside = short > j
            h[inside] += mix64(words[at[inside] + j] + factors[j]) * factors[j]
        h = mix64(h + short.astype(np.uint64) * factors[k])
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[begin[:-1][count > 0]] = True
    return h[new], np.concatenate(([0], np.cumsum(new)))[begin]


def signatures(sets: np.ndarray, begin: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures (texts x bins) of non-empty sets, densified."""
    n = np.diff(begin)
    doc = np.repeat(np.arange(len(n)), n)
    bin_ = (((sets >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    cell = doc * bins + bin_
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    sig, full = np.zeros(len(n) * bins, np.uint64), np.zeros(len(n) * bins, bool)
    sig[cell[first]], full[cell[first]] = sets[first], True
    donor = (random_u64(_ATTEMPTS * bins, 13) % np.uint64(bins)).astype(np.int64).reshape(_ATTEMPTS, bins)
    empty = np.flatnonzero(~full & np.repeat(n > 0, bins))
    row, col = empty // bins * bins, empty % bins
    for t in range(_ATTEMPTS):
        if not len(row):
            break
        src = row + donor[t, col]
        hit = full[src]
        sig[(row + col)[hit]] = sig[src[hit]]
        row, col = row[~hit], col[~hit]
    for r, c in zip(row, col, strict=True):  # about one bin in exp(2048 / bins): the next full bin
        step = int(np.argmax(full[r + (c + 1 + np.arange(bins)) % bins]))
        sig[r + c] = sig[r + (c + 1 + step) % bins]
    return sig.reshape(len(n), bins)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A bucket key of 64 bits for every text and band."""
    factors = random_u64(rows, 17) | np.uint64(1)
    with np.errstate(over="ignore"):
        h = (mix64(sig.reshape(len(sig), bands, rows)) * factors).sum(axis=2, dtype=np.uint64)
        return mix64(h + random_u64(bands, 19)).view(np.int64)


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                sets, begin = shingle_sets(data, offsets, k)
                n = np.diff(begin)
                one, two = mix64(sets ^ np.uint64(0xA5A5A5A5)), mix64(sets + np.uint64(0x1234567))
                sums = []
                with np.errstate(over="ignore"):
                    for part in (one, two):
                        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
                        sums.append((total[begin[1:]] - total[begin[:-1]]).view(np.int64))
                keys = band_keys(signatures(sets, begin, bands * rows), bands, rows)
                keys = pa.LargeListArray.from_arrays(np.arange(len(n) + 1) * bands, keys.ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), *map(pa.array, sums), keys.cast(pa.list_(pa.int64())),
                        *(batch.column(c).slice(a, b - a) for c in (2, 3)),
                    ],
                    ["doc_id", "n_shingles", "fp1", "fp2", "bands", "d1", "d2"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                sets, begin = shingle_sets(data, offsets, k)
                arrays = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), arrays], ["id", "s"])

    return run


def _across(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """A forest of links between components: the rows with ``asks`` against the others (columns comp, s)."""
        asks = np.asarray(table.column("asks"))
        sets = [np.asarray(x.values) for x in table.column("s")]
        comp = np.asarray(table.column("comp"))
        root = {c: c for c in set(comp.tolist())}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        edges = []
        if asks.any() and not asks.all():
            # the rarest shingles of every set come first; equally rare ones in the order of their hashes
            values, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            rank = np.empty(len(values), np.int64)
            rank[np.lexsort((values, often))] = np.arange(len(values))
            ends = np.cumsum([0, *map(len, sets)])
            ordered = [np.sort(rank[which[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            head = [x[: len(x) - -(-percent * len(x) // 100) + 1] for x in ordered]
            right = np.flatnonzero(~asks)
            key = np.concatenate([head[i] for i in right])
            owner = np.repeat(right, [len(head[i]) for i in right])
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            for i in np.flatnonzero(asks).tolist():
                lo, hi = np.searchsorted(key, head[i], "left"), np.searchsorted(key, head[i], "right")
                near = {j for a, b in zip(lo.tolist(), hi.tolist(), strict=True) for j in owner[a:b].tolist()} if (hi > lo).any() else ()
                mine = ordered[i]
                for j in near:
                    x, y, n = find(int(comp[i])), find(int(comp[j])), len(ordered[j])
                    if x == y or 100 * min(n, len(mine)) < percent * max(n, len(mine)):
                        continue
                    inter = len(np.intersect1d(mine, ordered[j], assume_unique=True))
                    if 100 * inter >= percent * (n + len(mine) - inter):
                        root[max(x, y)] = min(x, y)
                        edges.append((max(x, y), min(x, y)))
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _rest(buckets: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``comps`` after the links that the stars could not see: those between components that share a bucket."""
    live = buckets.select("bucket", "id", "n", "c").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    live = scratch.table(live, "live")
    open_ = live.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("id").alias("least"), F.count("*").alias("k")).where("x < y")
    open_ = scratch.table(open_.select("bucket", "least", "k"), "open")
    if open_.isEmpty():
        return comps
    spans = hot_join(live, open_.drop("k"), ["bucket"], live.groupBy("bucket").agg(F.count("*").alias("n")), ["id"]).where("least is not null")
    spans = scratch.table(spans, "spans")
    scratch.drop(live)
    families = components(spans.select(F.col("id").alias("a"), F.col("least").alias("b")), scratch).withColumnRenamed("comp", "fam")
    nodes = scratch.table(spans.select("id", "n", "comp").distinct().join(families, "id"), "nodes")
    scratch.drop(spans)
    blocks = lambda n: F.expr(f"cast(greatest(({n}) div {BLOCK} + 1, least({SPREAD}, ({n}) div {SPLIT} + 1)) as int)")
    part = nodes.groupBy("fam", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    fams = part.groupBy("fam").agg(
        F.max(F.struct("c", "comp")).alias("most"), F.sum("n").alias("n"), F.max_by("n", F.struct("c", "comp")).alias("inside"), F.sum("c").alias("k")
    )
    fams = scratch.table(
        fams.select(
            "fam",
            "k",
            F.col("most.comp").alias("largest"),
            blocks("n").alias("nt"),
            blocks("n - inside").alias("nq"),
        ),
        "fams",
    )
    # every block of the members outside the largest component meets every block of the family, once
    full = hot_join(nodes, fams.drop("k"), ["fam"], fams.select("fam", F.col("k").alias("n")), ["id"]).join(sets, "id")
    left = full.where("comp <> largest").select(
        "fam", F.expr("pmod(xxhash64(id), nq)").alias("q"), F.explode(F.expr("sequence(0L, nt - 1L)")).alias("t"), "comp", "s", F.lit(True).alias("asks")
    )
    right = full.select(
        "fam", F.explode(F.expr("sequence(0L, nq - 1L)")).alias("q"), F.expr("pmod(xxhash64(id), nt)").alias("t"), "comp", "s", F.lit(False).alias("asks")
    )
    links = left.unionByName(right).groupBy("fam", "q", "t").applyInArrow(_across(percent), "a bigint, b bigint")
    links = scratch.table(links.distinct(), "links")
    joined = scratch.table(components(links, scratch).withColumnRenamed("comp", "to"), "joined")
    moved = comps.join(joined.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    lone = joined.withColumnRenamed("to", "comp").join(comps, "id", "left_anti").select("id", "comp")
    return scratch.table(moved.unionByName(lone), "comps")


_KEY = ["n_shingles", "fp1", "fp2"]


def _digests(text: Column) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(F.lit(k), text).alias(f"d{k}") for k in (1, 2)]


def _id_key(column: str) -> list[Column]:
    """A doc_id as two columns that are never null, for plain equality."""
    return [F.coalesce(F.col(column).cast("bigint"), F.lit(0).cast("bigint")).alias("key_id"), F.col(column).isNull().alias("null_id")]


def _grouped(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, d1, d2, node, component_id) of every row: its set's node (null without words), and the least doc_id of the component."""
    scratch = Scratch(docs.sparkSession, "minhash")
    bands, rows = banding(percent / 100)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, bands array<bigint>, d1 bigint, d2 bigint"
    sig = scratch.table(texts.select("doc_id", "text", *_digests(F.col("text"))).mapInArrow(lean(_sketch(shingle, bands, rows)), schema), "sig")
    # texts with equal sets are one node; nodes are numbered in the order of their least doc_ids, so that the least node of a component has its least doc_id
    reps = sig.where("n_shingles > 0").groupBy(*_KEY).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = scratch.table(reps.orderBy(F.asc_nulls_last("rep"), *_KEY).withColumn("node", F.monotonically_increasing_id()), "nodes")
    same = [F.col(c) == F.col("_" + c) for c in _KEY] + [F.col("doc_id").eqNullSafe(F.col("rep"))]
    nodes = sig.join(reps.select("rep", "node", *[F.col(c).alias("_" + c) for c in _KEY]), same)
    rows_ = nodes.select(F.explode("bands").alias("bucket"), F.col("node").alias("id"), F.col("n_shingles").cast("int").alias("n")).distinct()
    rows_ = scratch.table(rows_, "rows")
    # the centre is the member with the least hash of its id, alike in all buckets, so that most members have few centres
    many = (
        rows_.groupBy("bucket")
        .agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("id").alias("h"), "id", "n")).alias("least"))
        .where("c > 1")
        .select("bucket", "c", F.col("least.id").alias("centre"), F.col("least.n").alias("m"))
    )
    many = scratch.table(many, "many")
    comps = None
    if not many.isEmpty():
        buckets = hot_join(rows_, many, ["bucket"], many.select("bucket", F.col("c").alias("n")), ["id"], rows_.count()).where("centre is not null")
        buckets = scratch.table(buckets, "buckets")
        scratch.drop(rows_)
        ids = buckets.select("id").distinct()
        # one text for each node: its rows have the same words
        full = nodes.select("node", *_id_key("doc_id"), "d1", "d2").join(ids.withColumnRenamed("id", "node"), "node", "left_semi")
        full = full.groupBy("node").agg(F.min(F.struct("null_id", "key_id", "d1", "d2")).alias("first")).select(F.col("node").alias("id"), "first.*")
        by = ["key_id", "null_id", "d1", "d2"]
        # equal rows are merged by the key of the join
        own = texts.select(*_id_key("doc_id"), *_digests(F.col("text")), "text").join(full, by).groupBy(*by).agg(F.first("id").alias("id"), F.first("text").alias("text"))
        sets = scratch.table(own.select("id", "text").mapInArrow(lean(_sets(shingle)), "id bigint, s array<bigint>"), "sets")

        def confirmed(pairs: DataFrame) -> DataFrame:
            both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(
                sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b"
            )
            inter = F.size(F.array_intersect("sa", "sb"))
            both = both.select("a", "b", inter.cast("bigint").alias("i"), (F.size("sa").cast("bigint") + F.size("sb")).alias("n"))
            return both.where(F.expr(f"100 * i >= {percent} * (n - i)")).select("a", "b").distinct()

        fits = f"100L * least(n, m) >= {percent}L * greatest(n, m)"
        first = buckets.where(f"id <> centre and {fits}").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        tested = scratch.table(first, "pairs")
        comps = scratch.table(components(confirmed(tested), scratch), "comps")
        scratch.drop(tested)
        comps = _rest(buckets.where("c > 2"), comps, sets, percent, scratch)
        by = comps.groupBy("comp").agg(F.count("*").alias("n"))
        comps = hot_join(comps, reps.select(F.col("node").alias("comp"), F.col("rep").alias("label")), ["comp"], by, ["id"])
        labels = reps.join(comps.select(F.col("id").alias("node"), F.col("comp"), "label"), "node", "left")
        labels = labels.select(*_KEY, F.coalesce("comp", "node").alias("node"), F.when(F.col("comp").isNull(), F.col("rep")).otherwise(F.col("label")).alias("component_id"))
    else:
        labels = reps.select(*_KEY, "node", F.col("rep").alias("component_id"))
    labels = scratch.table(labels, "labels")
    scratch.keep(sig, reps, labels)
    copies = reps.select(*_KEY, F.col("copies").alias("n"))
    out = hot_join(sig.drop("bands"), labels, _KEY, copies, ["doc_id", "d1", "d2"], sig.count())
    return out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(
    docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; links have 100 * intersection >= ``percent`` * union."""
    rows = _grouped(docs, shingle, percent, id_col, text_col)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (all columns) with one row of each group: that with the smallest doc_id, null ids last, and of unlike texts under it that with the least digest. Rows without words all stay."""
    rows = _grouped(docs, shingle, percent, "doc_id", "text").where("n_shingles > 0")
    first = rows.select("node", *_id_key("doc_id"), "d1", "d2").groupBy("node").agg(F.min(F.struct("null_id", "key_id", "d1", "d2")).alias("first"))
    text, names = F.col("text").cast("string"), docs.columns
    keys = [c.alias(f"__{i}") for i, c in enumerate([*_id_key("doc_id"), *_digests(text)])]
    by = [f"__{i}" for i in range(4)]
    first = first.select(*[F.col(f"first.{c}").alias(k) for c, k in zip(("key_id", "null_id", "d1", "d2"), by, strict=True)])
    # the characters between words, as the operator cuts them
    blank = text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]")
    # rows alike in id and text are one, merged by the key of the join
    full = docs.where(~blank).select("*", *keys).join(first, by, "left_semi").dropDuplicates(by)
    return full.select(*[f"`{c}`" for c in names]).unionByName(docs.where(blank))
