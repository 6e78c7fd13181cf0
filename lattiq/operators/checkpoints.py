"""Checkpoint records and mesh layouts as tables with their consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "path string, number int, time double, cycle long, dt double, includes_ghost boolean, n_ghost int, last_sequence long, mesh array<int>, block array<int>, n_blocks long, blocks_per_process array<int>"


def layout_errors(checkpoints: DataFrame) -> DataFrame:
    """(path, error) of layouts that do not fit: blocks must divide the mesh, their number and their sum over processes must agree."""
    whole = F.forall(F.zip_with("mesh", "block", lambda m, b: (b > 0) & (m % b == 0)), lambda x: F.coalesce(x, F.lit(False)))
    number = F.aggregate(F.zip_with("mesh", "block", lambda m, b: F.when(b > 0, F.floor(m / b)).otherwise(F.lit(0).cast("long"))), F.lit(1).cast("long"), lambda a, x: a * x)
    summed = F.aggregate("blocks_per_process", F.lit(0).cast("long"), lambda a, x: a + x)
    faults = F.array_compact(F.array(F.when(~whole, F.lit("block does not divide mesh")), F.when(number != F.col("n_blocks"), F.lit("number of blocks")), F.when(F.col("blocks_per_process").isNotNull() & (summed != F.col("n_blocks")), F.lit("blocks of processes"))))
    return checkpoints.select("path", F.explode(faults).alias("error"))


def last_frame(time: Column, start: Column, cadence: Column) -> Column:
    """Number of the last frame written before a checkpoint's time."""
    return F.floor((time - start) / cadence + 1e-9).cast("long")


def repack_rollup(archives: DataFrame) -> DataFrame:
    """(scheme, before, after, saved) of archives (scheme, bytes_before, bytes_after): sums first, then the share."""
    sums = archives.groupBy("scheme").agg(F.sum("bytes_before").alias("before"), F.sum("bytes_after").alias("after"))
    return sums.withColumn("saved", F.round(1 - F.col("after") / F.greatest("before", F.lit(1)), 6))
