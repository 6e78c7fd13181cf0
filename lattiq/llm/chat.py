"""Chat formatting with collapse of cumulative snapshots, in DataFrame functions alone.

A conversation that is logged after every turn appears as many conversations, each
the beginning of the next.  Rolling hashes of the turns (two 64-bit lanes over
position, role and text) name every prefix; a conversation whose whole is a proper prefix of a longer
one, or that repeats another, goes.  Hashes are made of narrow rows; texts move
once, for the conversations that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with ``conv``, their conversation's key; a turn without conversation id is one of its own."""
    own = F.concat(F.lit("row:"), F.monotonically_increasing_id().cast("string"))
    chosen = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return chosen.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), own))


def _content(lane: int) -> Column:
    # A null adds nothing to a hash, so it is told apart by its flag.
    return F.xxhash64(F.lit(lane), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, n_turns) of the conversations that no other one begins with or equals; of equals the smallest id stays."""
    narrow = _turns(conversations).select("conv", "conv_id", "turn", _content(1).alias("h1"), _content(2).alias("h2"))
    order = Window.partitionBy("conv").orderBy("turn", "h1", "h2")
    placed = narrow.withColumn("pos", F.row_number().over(order))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.withColumn("r1", F.expr("bit_xor(xxhash64(pos, h1))").over(running)).withColumn("r2", F.expr("bit_xor(xxhash64(pos, h2))").over(running)).withColumn("n_turns", F.count("*").over(Window.partitionBy("conv")))
    whole = rolled.filter("pos = n_turns").groupBy("n_turns", "r1", "r2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "conv")).alias("first"))
    begun = rolled.filter("pos < n_turns").select(F.col("pos").cast("long").alias("n_turns"), "r1", "r2").distinct()
    return whole.join(begun, ["n_turns", "r1", "r2"], "left_anti").select(F.col("first.conv").alias("conv"), F.col("first.conv_id").alias("conv_id"), "n_turns")


def format_chats(conversations: DataFrame, *, opening: str = "<|im_start|>", closing: str = "<|im_end|>", no_role: str = "unknown") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, chat (all turns, rendered in order).

    Turns are ordered by turn, null first, equal turns by content; a turn is rendered
    as opening mark, role, newline, text, closing mark, newline.  A null role is ``no_role`` and a null
    text is empty, but both differ from these values when conversations are compared.
    Rows without conversation id stand alone.  Repeated rows of a conversation are
    turns like any other.  An empty table gives an empty result; other columns are not read.
    """
    turns = _turns(conversations)
    kept = maximal_conversations(conversations)
    line = F.concat(F.lit(opening), F.coalesce("role", F.lit(no_role)), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(closing + "\n"))
    told = turns.select("conv", "turn", _content(1).alias("h1"), _content(2).alias("h2"), line.alias("line")).join(kept, "conv")
    chats = told.groupBy("conv", "conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("turn", "h1", "h2", "line"))).alias("all"))
    return chats.select("conv_id", "n_turns", F.array_join(F.transform("all", lambda x: x["line"]), "").alias("chat"))


ORACLE = r"""
    WITH conv AS (
        SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chat
        FROM conversations GROUP BY conv_id
    )
    SELECT conv_id, n_turns, chat FROM conv a
    WHERE NOT EXISTS (SELECT 1 FROM conv b WHERE (b.n_turns > a.n_turns AND starts_with(b.chat, a.chat)) OR (b.chat = a.chat AND b.conv_id < a.conv_id))
"""
