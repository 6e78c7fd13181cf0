"""Differencing of codes inside chunks, its inverse, and the choice between orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N


def chunked(codes: DataFrame, size: int) -> DataFrame:
    """Chunk of each code (channel, pos, code): chains restart with every ``size`` frames, the first of which follows an anchor."""
    return codes.withColumn("chunk", F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / size))


def _line(keys=("channel", "chunk")):
    return Window.partitionBy(*keys).orderBy("pos")


def delta(codes: DataFrame, order: int, bits: int = 8, keys: tuple[str, ...] = ("channel", "chunk")) -> DataFrame:
    """Wrapped first or second differences: a chunk's first code is kept, its second is a first difference in either order."""
    return codes.withColumn("delta", _difference(order, bits, keys))


def _difference(order: int, bits: int, keys: tuple[str, ...]) -> Column:
    one, two = (F.lag("code", k).over(_line(keys)) for k in (1, 2))
    raw = F.col("code") - F.coalesce(one, F.lit(0))
    if order == 2:
        raw = F.when(two.isNotNull(), F.col("code") - 2 * one + two).otherwise(raw)
    return N.wrapped(raw, bits)


def restored(deltas: DataFrame, order: int, bits: int = 8, keys: tuple[str, ...] = ("channel", "chunk")) -> DataFrame:
    """Codes from differences: running sums, taken twice from the second member on for the second order, wrapped once."""
    upto = _line(keys).rowsBetween(Window.unboundedPreceding, 0)
    if order == 1:
        return deltas.withColumn("back", N.wrapped(F.sum("delta").over(upto), bits))
    first = F.row_number().over(_line(keys)) == 1
    steps = deltas.withColumn("_first", first).withColumn("_step", F.sum(F.when(F.col("_first"), F.lit(0)).otherwise(F.col("delta"))).over(upto))
    back = F.first("delta").over(upto) + F.sum("_step").over(upto)
    return steps.withColumn("back", N.wrapped(back, bits)).drop("_first", "_step")


def bit_length(code: Column) -> Column:
    """Bits of a zigzag code, at least one: what a chunk would cost about."""
    return F.when(code <= 0, F.lit(1)).otherwise(F.floor(F.log2(code.cast("double"))) + 1).cast("long")


def adaptive_order(codes: DataFrame) -> DataFrame:
    """(channel, chunk, order, cost) of the cheaper difference order of each chunk; first order when equal."""
    keys = ("channel", "chunk")
    both = codes.select(*keys, *(N.zigzag(_difference(k, 8, keys)).alias(f"d{k}") for k in (1, 2)))
    cost = both.groupBy(*keys).agg(*(F.sum(bit_length(F.col(f"d{k}"))).alias(f"c{k}") for k in (1, 2)))
    return cost.select(*keys, F.when(F.col("c1") <= F.col("c2"), 1).otherwise(2).alias("order"), F.least("c1", "c2").alias("cost"))


def keyframe_orders(anchors: DataFrame, interval: int) -> DataFrame:
    """Difference order of each anchor (channel, gop) by its place in the interval: none, first, then second."""
    return anchors.withColumn("order", F.least(F.col("gop") % interval, F.lit(2)).cast("int"))


def keyframe_chain(anchors: DataFrame, interval: int) -> DataFrame:
    """(channel, gop, needs): every anchor that decoding an anchor touches; chains are shorter than the interval."""
    return anchors.select("channel", "gop", F.sequence(F.col("gop") - F.col("gop") % interval, F.col("gop")).alias("needs"))
