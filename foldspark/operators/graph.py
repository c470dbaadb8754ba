"""Connected components of a graph in two tables, without recursion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.sources.kept import Kept

#: Edges that one task joins; a larger graph is contracted until no more are left.
TOGETHER = 2_000_000


def least_nodes(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that can be reached from each of ``n`` nodes: roots hook onto their least neighbour's root, then all paths are shortened."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = low != high
        a, b = a[live], b[live]
        np.minimum.at(root, high[live], low[live])
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, to): the ends of all edges of one task with the least id that can be reached."""
    batches = [x for x in batches if x.num_rows]
    if not batches:
        return
    edges = pa.Table.from_batches(batches)
    ends = pa.chunked_array([*edges.column(0).chunks, *edges.column(1).chunks]).combine_chunks()
    ids = pc.unique(ends)
    ids = ids.take(pc.sort_indices(ids))
    code = pc.index_in(ends, ids).to_numpy(zero_copy_only=False)
    root = least_nodes(code[: len(code) // 2], code[len(code) // 2 :], len(ids))
    for at in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([ids[at : at + 100_000], ids.take(pa.array(root[at : at + 100_000]))], ["id", "to"])


def _contracted(kept: Kept, edges: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(id, to) and the edges left: every node goes to the end of its path over least neighbours, by hash, which keeps the paths short."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
    to = kept.table(least.select(F.col("a").alias("id"), F.least(rank("a"), F.col("m"))["id"].alias("to")))
    for _ in range(rounds):
        far = to.select(F.col("id").alias("k"), F.col("to").alias("far"))
        nxt = kept.table(to.join(far, F.col("to") == F.col("k")).select("id", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
        moved = bool(nxt.where("moved").limit(1).count())
        kept.drop(to)
        to = nxt
        if not moved:
            break
    else:
        raise RuntimeError(f"paths did not end in {rounds} rounds")
    for c in ("a", "b"):
        edges = edges.join(to.select(F.col("id").alias(c), F.col("to").alias("t" + c)), c)
    left = edges.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
    return to.select("id", "to"), kept.table(left)


def connected_components(vertices: DataFrame, edges: DataFrame, rounds: int = 200, together: int = TOGETHER) -> DataFrame:
    """(id, comp) for ``vertices`` (id) and undirected ``edges`` (a, b) between them: the least id that can be reached.

    Up to ``together`` edges are joined by one task. A larger graph is contracted first: every round halves the nodes that still have an edge, so the rounds grow with the logarithm of the
    nodes and not with a component's diameter. Every round is written to the shared folder.
    """
    kept = Kept(vertices.sparkSession, "components")
    now = kept.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    for _ in range(rounds):
        if now.count() <= together:
            break
        to, left = _contracted(kept, now, rounds)
        maps.append(to)
        kept.drop(now)
        now = left
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    kind = now.schema["a"].dataType.simpleString()
    maps.append(kept.table(now.coalesce(1).mapInArrow(_joined, f"id {kind}, to {kind}")))
    kept.drop(now)
    out = vertices.select("id", F.col("id").alias("comp")).distinct()
    for to in maps:
        step = to.select(F.col("id").alias("k"), "to")
        out = out.join(step, out.comp == step.k, "left").select("id", F.coalesce("to", "comp").alias("comp"))
    if len(maps) == 1:
        return out
    # after a contraction a component bears the name of one of its nodes, not of the least
    out = kept.table(out)
    least = out.groupBy(F.col("comp").alias("k")).agg(F.min("id").alias("least"))
    return out.join(least, out.comp == least.k).select("id", F.col("least").alias("comp"))
