"""Requests, caches and reports around a sequence: de-duplication, limits, eviction, reuse of digests, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_requests(requests: DataFrame, keys: list[str], wanted: str, order: str, limit: int | None = None) -> DataFrame:
    """(keys, wanted, order): every wanted value once, at its first request; more than ``limit`` of a key are an error, never cut."""
    once = requests.groupBy(*keys, wanted).agg(F.min(order).alias(order))
    if limit is None:
        return once
    many = once.groupBy(*keys).agg(F.count("*").alias("_n"))
    over = F.when(F.col("_n") > limit, F.raise_error(F.lit(f"more than {limit} frames asked for at once")).cast("boolean")).otherwise(F.lit(True))
    return once.join(many, keys).filter(over).drop("_n")


def first_middles(middles: DataFrame, stride: int, most: int) -> DataFrame:
    """The first ``most`` middle frames of every group; 0 takes all."""
    return middles if not most else middles.filter(F.col("pos") % stride <= most)


def selected_scheme(archives: DataFrame, keys: list[str], name: str, explicit: str | None = None) -> DataFrame:
    """The scheme to decode for each key: the one asked for where it is there, or the first by name."""
    asked = archives if explicit is None else archives.filter(F.col(name) == explicit)
    return asked.groupBy(*keys).agg(F.min(name).alias(name))


def first_errors(errors: DataFrame, keys: list[str], order: str, most: int = 8) -> DataFrame:
    """(keys, number, examples): how many errors each key has, and the first ``most`` of them in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    some = errors.withColumn("_rank", rank).filter(F.col("_rank") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("examples"))
    return errors.groupBy(*keys).agg(F.count("*").alias("number")).join(some, keys)


def coverage(truth: DataFrame, parts: DataFrame, keys: list[str], place: str) -> DataFrame:
    """(keys, missing, unexpected, equal): whether ``parts`` are the places of ``truth``, both ways."""
    sides = truth.select(*keys, place).distinct().withColumn("_t", F.lit(1)).unionByName(parts.select(*keys, place).distinct().withColumn("_t", F.lit(2)))
    seen = sides.groupBy(*keys, place).agg(F.sum("_t").alias("_seen"))
    told = seen.groupBy(*keys).agg(F.count_if(F.col("_seen") == 1).alias("missing"), F.count_if(F.col("_seen") == 2).alias("unexpected"))
    return told.withColumn("equal", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def reused_digests(files: DataFrame, known: DataFrame, identity: list[str], content: str) -> DataFrame:
    """(identity, sha256, reused): the known digest of a file whose identity did not change, else that of its content."""
    old = known.select(*identity, F.col("sha256").alias("_old"))
    told = files.join(old, identity, "left")
    return told.select(*identity, F.coalesce("_old", F.sha2(content, 256)).alias("sha256"), F.col("_old").isNotNull().alias("reused"))


def evicted(files: DataFrame, cache: list[str], order: list[str], protected: Column, keep: int) -> DataFrame:
    """Files that a cache of at most ``keep`` lets go: the oldest that nothing protects, as many as are over."""
    mine = Window.partitionBy(*cache)
    told = files.withColumn("_safe", protected).withColumn("_n", F.count("*").over(mine))
    rank = F.row_number().over(Window.partitionBy(*cache, "_safe").orderBy(*order))
    return told.withColumn("_rank", rank).filter(~F.col("_safe") & (F.col("_rank") <= F.col("_n") - keep)).drop("_safe", "_n", "_rank")


def service_counters(log: DataFrame, keys: list[str], hit: Column, size: Column, seconds: Column) -> DataFrame:
    """Requests, cache hits, decoded frames, bytes sent and mean seconds of a decode; partial sums merge."""
    return log.groupBy(*keys).agg(F.count("*").alias("requests"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("decoded"), F.sum(size).alias("bytes"), F.avg(F.when(~hit, seconds)).alias("mean_seconds"))


def attribute_between(start: Column, end: Column, weight: Column, whole: bool) -> Column:
    """An attribute between two anchors: numbers on the line, whole ones rounded with ties to even."""
    line = (F.lit(1.0) - weight) * start.cast("double") + weight * end.cast("double")
    return F.rint(line).cast("long") if whole else line


def physical_time(info: Column, attribute: Column) -> Column:
    """A frame's time: that of its information block, or its file's attribute."""
    return F.coalesce(info, attribute)


def listed_tau(taus: Column, legacy: Column, number: Column) -> Column:
    """A frame's weight from the list in the metadata, counted from 1, or from an older archive's own member."""
    return F.coalesce(F.get(taus, number - 1), legacy)
