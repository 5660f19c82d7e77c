"""Chat formatting: conversations logged again as they grew are collapsed to the longest, then rendered.

Turns are numbered in their conversation, and the rolling hash of a prefix is the sum over its turns of two 64-bit
parts of SHA-256 of (position, role, text), kept exactly as decimals. A conversation whose whole hash is the prefix
hash of a longer one is dropped by an anti-join; of equal conversations the smallest ``conv_id`` stays.

All of it is built-in expressions, joins and windows. Running numbers and sums are made in two levels, within blocks and then over the blocks of
a conversation. Blocks are cut by Spark's range partitioning on (conversation, turn, role, text), so they hold about equally many rows whatever the
turn numbers are, and one endless conversation, also one without any turn numbers, is spread over many tasks.
The result has a row per turn, with its place in the conversation's text, since a conversation may be larger than a cell can be.

Null roles and texts are empty, null turns come first, null ``conv_id`` rows form one conversation. A turn that is repeated
exactly (same conversation, number, role and text) counts once; different turns of one number are ordered by role and text.
An empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotaflow.llm.common import stored

# The markup of a turn: fixed values of the format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _running(turns: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Adds running sums (the row itself included) in the order of a conversation: new name -> column."""
    order = ["turn", "role", "text"]
    inner = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy(F.col("conv_id").alias("of"), F.col("block").alias("at")).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    blocks = blocks.select("of", "at", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    same = F.col("conv_id").eqNullSafe(F.col("of")) & F.col("block").eqNullSafe(F.col("at"))
    turns = turns.withColumns({n: F.sum(c).over(inner) for n, c in sums.items()}).join(blocks, same)
    return turns.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("of", "at", *[f"_{n}" for n in sums])


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, position (from 1) and the prefix hash (h1, h2) of each turn."""
    turns = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = turns.distinct().repartitionByRange(*order).withColumn("block", F.spark_partition_id())
    turns = stored(placed, "placed-turns").withColumn("one", F.lit(1).cast("long"))
    turns = _running(turns, {"position": "one"})
    digest = F.sha2(F.concat_ws("\0", F.col("position").cast("string"), F.octet_length("role").cast("string"), "role", "text"), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    turns = turns.withColumns({"d1": part(1), "d2": part(17)})
    return _running(turns, {"h1": "d1", "h2": "d2"}).drop("d1", "d2", "one")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that prefix no other one.

    Both sides of the joins have one row per hash, so no hash is hot.
    """
    key = ["n_turns", "h1", "h2"]
    prefixes = turns.select("conv_id", F.col("position").alias("n_turns"), "h1", "h2")
    whole = prefixes.groupBy(F.col("conv_id")).agg(F.max(F.struct("n_turns", "h1", "h2")).alias("w")).select("conv_id", "w.*")
    whole = stored(whole.groupBy(*key).agg(F.min(F.struct(F.col("conv_id").isNull(), F.col("conv_id"))).alias("m")).select(*key, "m.conv_id"), "whole-hashes")
    counts = prefixes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("n_turns", "h1", "h2")).alias("w")).select("w.*")
    ends = ends.groupBy(*key).agg(F.count(F.lit(1)).alias("ended"))
    inside = counts.join(ends, key, "left").where("ended IS NULL OR n > ended").select(*key)
    return whole.join(inside, key, "left_anti").select("conv_id", "n_turns")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, position, place (first character in the conversation's text) and piece of the kept conversations' turns."""
    turns = stored(hashed_turns(conversations), "turns")
    kept = maximal(turns).select(F.col("conv_id").alias("kept"), "n_turns")
    turns = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept"))).drop("kept", "h1", "h2")
    turns = turns.withColumn("piece", F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n")))
    turns = turns.withColumn("chars", F.length("piece").cast("long"))
    placed = _running(turns, {"end": "chars"})
    return placed.select("conv_id", "n_turns", "position", (F.col("end") - F.col("chars")).alias("place"), "piece")
