"""Checkpoints, retention, history segments, rollback, anchor sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(checkpoints: DataFrame, keys: list[str], complete: Column, order: str) -> DataFrame:
    """Newest complete checkpoint of each key."""
    return checkpoints.filter(complete).groupBy(*keys).agg(F.max(F.struct(order, *[c for c in checkpoints.columns if c not in (*keys, order)])).alias("c")).select(*keys, "c.*")


def newest(rows: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """The ``keep`` newest rows of each key with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= keep)


def allocation(segments: DataFrame, group: list[str], order: str, rows: str, limit: int) -> DataFrame:
    """How many rows of each ordered segment stay under one limit over all segments of a group."""
    before = F.coalesce(F.sum(rows).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.withColumn("kept", F.greatest(F.lit(0).cast("long"), F.least(F.col(rows), F.lit(limit) - before)))


def combined_history(lines: DataFrame) -> DataFrame:
    """Data lines of ordered history segments (segment, line_no, text); the first segment's comments head the result."""
    comment = F.col("text").startswith("#")
    first = lines.agg(F.min("segment").alias("first"))
    told = lines.crossJoin(F.broadcast(first)).filter(~comment | (F.col("segment") == F.col("first")))
    return told.select(comment.alias("is_comment"), "segment", "line_no", "text")


def rollback(frames: DataFrame, to_pos: int, stride: int, ghost: bool = True) -> DataFrame:
    """What goes when a series returns to ``to_pos``; that has to be the end of a group, with ghost zones written."""
    if to_pos % stride or not ghost:
        raise ValueError("a rollback needs ghost zones and the end of a group")
    return frames.filter(F.col("pos") > to_pos)


def preferred(sources: DataFrame, key: str, priority: str, target: str) -> DataFrame:
    """The best source of each key by priority."""
    return sources.groupBy(key).agg(F.min_by(target, priority).alias(target), F.min(priority).alias(priority))
