"""Audits of sequences and files: order, cadence, finiteness, sizes, digests, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import with_positions


def monotonic(frames: DataFrame) -> DataFrame:
    """Frames, and how many do not come after the one before, by channel.  Neighbours are found by position, without a window over the series."""
    before = frames.select("channel", (F.col("pos") + 1).alias("pos"), F.col("time").alias("before"))
    return frames.join(before, ["channel", "pos"], "left").groupBy("channel").agg(F.count("*").alias("frames"), F.count_if(F.col("before") >= F.col("time")).alias("violations"))


def cadence_stats(frames: DataFrame) -> DataFrame:
    before = frames.select("channel", (F.col("pos") + 1).alias("pos"), F.col("time").alias("before"))
    gap = F.round(F.col("time") - F.col("before"), 6)
    return frames.join(before, ["channel", "pos"]).groupBy("channel").agg(F.min(gap).alias("min_dt"), F.max(gap).alias("max_dt"), F.count("*").alias("gaps"))


def cadence_violations(frames: DataFrame, cadence: Column, tolerance: Column) -> DataFrame:
    """Frames whose time is off the regular grid that starts with the channel's first frame."""
    first = frames.groupBy("channel").agg(F.min_by("time", "pos").alias("first_time"))
    off = F.abs(F.col("time") - (F.col("first_time") + F.col("pos") * cadence))
    return frames.join(first, "channel").groupBy("channel").agg(F.count("*").alias("frames"), F.count_if(off > tolerance).alias("violations"))


def finite(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    x = F.col(column).cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.groupBy(*keys).agg(F.count("*").alias("cells"), F.count_if(F.coalesce(bad, F.lit(False))).alias("non_finite"), F.count_if(x.isNull()).alias("missing"))


def size_outliers(files: DataFrame, key: str, size: Column, ratio: float) -> DataFrame:
    """Files smaller than ``ratio`` times the median size, exactly: ranks are counted in ranges of a 64th of an octave, so no task sees all sizes."""
    sized = files.select(key, size.alias("size")).filter("size is not null")
    ranked = with_positions(sized.select("size", F.lit(0).alias("_all")), ["_all"], ["size"], F.floor(F.log2(F.col("size") + F.lit(1.0)) * 64))
    number = sized.agg(F.count("*").alias("_n"))
    middle = ranked.join(F.broadcast(number), F.col("pos").between(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))).agg(F.avg("size").alias("median"))
    return sized.crossJoin(F.broadcast(middle)).filter(F.col("size") < F.col("median") * ratio).select(key, "size")


def digests(files: DataFrame, key: str, payload: str) -> DataFrame:
    return files.select(key, F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).cast("long").alias("bytes"))


def mismatches(recorded: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Keys whose computed digest is not the recorded one."""
    return recorded.select(key, F.col("sha256").alias("recorded")).join(computed.select(key, F.col("sha256").alias("computed")), key).filter("recorded <> computed").select(key)
