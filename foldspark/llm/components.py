"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.shared import Scratch, hot_join


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step over ``total`` edges (a, b) with a > b: neighbours move to the least neighbour, which comes from an aggregate with map-side combine. A hub's edges are dealt over several keys."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select("a", "b")
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    out = hot_join(near, least.drop("n"), ["a"], least.select("a", "n"), ["b"], total).where("b > a" if large else "b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.where("a > m").select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(id, comp) for every end of ``edges`` (columns a, b: bigint); comp is the least id that can be reached.

    Self edges and null ends are ignored; no edges give an empty table. Every step costs two shuffles of the edges left; the
    steps grow with the logarithm of the longest path. Raises if ``rounds`` do not suffice, rather than return part of the answer.
    """
    now = scratch.table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    before = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == before or not seen[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(
                now.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
            )
        before = seen
        half = scratch.table(_star(now, True, 2 * seen[0]), "cc")
        nxt = scratch.table(_star(half, False, half.count()), "cc")
        scratch.drop(half)
        scratch.drop(now)
        now = nxt
    raise RuntimeError(f"components did not settle in {rounds} rounds")
