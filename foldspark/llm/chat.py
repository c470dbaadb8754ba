"""Chat formatting: logged snapshots collapse to their longest, which are then rendered.

A conversation logged after every turn leaves many snapshots, each a prefix of the next. Every turn gets a rolling hash of its conversation up to it: the exclusive or
of a 128-bit hash of (place, role, text) over all turns so far. A conversation whose whole hash is that of a strict prefix of another is dropped by an anti-join; of
equal conversations the one with the smallest conv_id stays.

The place of a turn is its rank in its conversation. Turns are dealt to tasks by ranges of (conversation, turn, role, digest of the text, row), so that the turns of one conversation, of one turn
number, even rows alike in all columns, are split when they are many; rank and rolling hash come from each range and sums over the ranges before it. Texts take no part in this: their
digests do, and only texts of conversations that stay meet their places. Rendering makes one row for every ``PART`` places: joined in the order of ``part`` they are the conversation's text.

Defined cases: turns are ordered by (turn, role), nulls first; texts of one turn and role by their MD5 digests. A null turn sorts first, null role and text render and compare
as empty. Repeated rows are turns of their own. All rows with a null conv_id are one conversation. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.shared import Scratch

#: Turns of a rendered row.
PART = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(turns: DataFrame) -> DataFrame:
    """The four columns, nulls filled, with the text's digest."""
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.withColumn("digest", F.md5(F.encode("text", "UTF-8")))


def placed(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, role, digest, range, own, place, n): every turn's place 1, 2, ... among the ``n`` of its conversation, and its own in its range."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "row"]
    rows = _turns(turns).drop("text").withColumn("row", F.monotonically_increasing_id())
    rows = scratch.table(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "dealt")
    own = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order[1:]))
    rows = rows.withColumn("own", own).drop("row")
    sizes = rows.groupBy("conv_id", "range").agg(F.count("*").alias("k"))
    conv = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("k").over(conv.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), before.alias("before"), F.sum("k").over(conv).alias("n"))
    both = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r")))
    return scratch.table(both.select("conv_id", "turn", "role", "digest", "range", "own", (F.col("before") + F.col("own")).alias("place"), "n"), "placed")


def rolled(places: DataFrame) -> DataFrame:
    """(conv_id, place, n, h1, h2): the rolling hashes of every conversation up to its turn ``place``."""
    rows = places.select("conv_id", "range", "own", "place", "n", *[F.xxhash64(F.lit(k), "place", "role", "digest").alias(f"t{k}") for k in (1, 2)])
    at = Window.partitionBy("conv_id", "range").orderBy("own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "range").agg(*[F.bit_xor(f"t{k}").alias(f"t{k}") for k in (1, 2)])
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), *[F.coalesce(F.bit_xor(f"t{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    rows = rows.withColumns({f"r{k}": F.bit_xor(f"t{k}").over(at) for k in (1, 2)})
    rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r")))
    xor: list[Column] = [F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"h{k}") for k in (1, 2)]
    return rows.select("conv_id", "place", "n", *xor)


def maximal(rolls: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no longer one begins with, one of each set of equal ones."""
    # equal conversations: an aggregate with map-side combine, whatever their number
    whole = rolls.where("place = n").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    strict = rolls.where("place < n").select("place", "h1", "h2").distinct()
    return whole.join(strict, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations of ``turns`` (conv_id, turn, role, text) as chat text; part counts from 0."""
    scratch = Scratch(turns.sparkSession, "chat")
    places = placed(turns, scratch)
    kept = maximal(scratch.table(rolled(places), "rolled")).select(F.col("conv_id").alias("_k"), "n_turns")
    key = ["conv_id", "turn", "role", "digest"]
    # rows alike in all columns have neighbouring places: one row for them, with the first and the last
    spans = places.groupBy(*key).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    spans = spans.join(kept, F.col("conv_id").eqNullSafe(F.col("_k"))).select(*[F.col(c).alias("_" + c) for c in key], "first", "last", "n_turns")
    spans = scratch.table(spans, "spans")
    scratch.keep(spans)
    texts = _turns(turns).groupBy(*key).agg(F.first("text").alias("text"))
    rows = texts.join(spans, [F.col(c).eqNullSafe(F.col("_" + c)) for c in key])
    piece = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n"))
    rows = rows.select("conv_id", "n_turns", "first", "last", piece.alias("s"), F.explode(F.expr(f"sequence((first - 1) div {PART}, (last - 1) div {PART})")).alias("part"))
    times = F.expr(f"cast(least(last, (part + 1) * {PART}) - greatest(first, part * {PART} + 1) + 1 as int)")
    rows = rows.select("conv_id", "part", "n_turns", F.struct("first", F.repeat("s", times).alias("s")).alias("p"))
    # at most PART pieces a row
    parts = rows.groupBy("conv_id", "part", "n_turns").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return parts.select("conv_id", "part", "n_turns", F.array_join("p.s", "").alias("text"))
