"""Chat formatting: logged conversations are snapshots that grow turn by turn; only maximal ones are rendered.

A turn is a row (conversation, turn, role, text). Exactly repeated rows count once. Turns are ordered by (turn, role,
text), nulls first; a null conversation id is a conversation of its own; null role and text count as empty. A conversation
is a snapshot of another if its turns, in order, are the first turns of the other; of equal conversations the smallest id
stays. A prefix is known by two running sums of 64-bit hashes over (position, role, text). Long conversations are cut
into blocks of turns, whose sums are added first: no window and no rendered part holds more than a block of turns (rows
that share one turn number are in one block). Texts may be of any length; other columns aren't read, so their names may
clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.tables import join_groups, saved

#: Turn numbers in a block.
BLOCK = 64


def _positions(turns: DataFrame, block: int) -> DataFrame:
    """turns (conv, turn, role, text), each row once, with blk, pos (1-based place), running hash sums h1 and h2, and of the
    conversation n_turns, n_parts and part (its blocks and this one's place, from 0).

    Tables of one row per conversation and block carry sums and places from block to block; turns join them by both.
    """
    t = turns.groupBy("conv", "turn", "role", "text").agg(F.lit(1).alias("one")).drop("one")
    t = t.withColumn("blk", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long"))
    t = t.withColumns({"c0": F.coalesce("conv", F.lit(0)), "none": F.col("conv").isNull()})
    conv = ["c0", "none"]
    by_blk, every = Window.partitionBy(*conv).orderBy("blk"), Window.partitionBy(*conv)
    back = by_blk.rowsBetween(Window.unboundedPreceding, -1)
    per_block = t.groupBy(*conv, "blk").agg(F.count("*").alias("n"))
    starts = per_block.select(
        *conv, "blk", F.coalesce(F.sum("n").over(back), F.lit(0)).alias("start"), F.sum("n").over(every).alias("n_turns"),
        (F.row_number().over(by_blk) - 1).cast("long").alias("part"), F.count("*").over(every).alias("n_parts"),
    )
    inside = Window.partitionBy(*conv, "blk").orderBy("turn", "role", "text")
    t = t.withColumn("at", F.row_number().over(inside)).join(starts, [*conv, "blk"]).withColumn("pos", F.col("start") + F.col("at"))
    # 64-bit sums are kept in decimals.
    for i in (1, 2):
        t = t.withColumn(f"d{i}", F.xxhash64(F.lit(i), "pos", "role", "text").cast("decimal(38,0)"))
    sums = t.groupBy(*conv, "blk").agg(F.sum("d1").alias("b1"), F.sum("d2").alias("b2"))
    before = sums.select(*conv, "blk", *[F.coalesce(F.sum(f"b{i}").over(back), F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)])
    t = t.join(before, [*conv, "blk"])
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    for i in (1, 2):
        t = t.withColumn(f"h{i}", (F.col(f"s{i}") + F.sum(f"d{i}").over(run)).cast("decimal(38,0)"))
    return t.select("conv", *conv, "turn", "role", "text", "blk", "pos", "h1", "h2", "n_turns", "part", "n_parts")


def maximal_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The turns (conv, turn, role, text, pos, n_turns, part, n_parts) of conversations that no other one extends or repeats."""
    turns = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = saved(_positions(turns, block))
    prefix = ["n_turns", "h1", "h2"]
    # Equal conversations: the smallest id stands for all, a null one for itself alone.
    whole = t.filter(F.col("pos") == F.col("n_turns"))
    heads = whole.groupBy(*prefix).agg(F.min(F.struct("none", "c0")).alias("m")).select("m.none", "m.c0", *prefix)
    # A prefix of a longer one is a place with that hash before that conversation's end.
    inner = t.filter(F.col("pos") < F.col("n_turns")).select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    keep = saved(heads.join(inner, prefix, "left_anti").select("none", "c0", "n_turns"))
    return join_groups(t, keep.withColumnRenamed("n_turns", "kept"), ["none", "c0"], "kept").select("conv", "turn", "role", "text", "pos", "n_turns", "part", "n_parts")


def render_chat(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """One row per conversation and block of turns: conv, part (from 0), n_parts, n_turns, text. Parts in order are the whole."""
    line = F.concat(F.lit(start), "role", F.lit("\n"), "text", F.lit(end), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return turns.groupBy("conv", "part", "n_parts", "n_turns").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("text"))
