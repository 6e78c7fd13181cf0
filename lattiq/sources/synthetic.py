"""A small analytic sequence: smooth fields on an 8 x 16 x 64 grid at slightly uneven times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sequence(spark: SparkSession, frames: int = 51, shape: tuple[int, int, int] = (8, 16, 64)) -> DataFrame:
    """(sequence, time, cell, rho, u): one row per frame and cell."""
    cells = shape[0] * shape[1] * shape[2]
    told = spark.range(frames * cells).select(F.floor(F.col("id") / cells).alias("sequence"), (F.col("id") % cells).alias("cell"))
    n = F.col("sequence").cast("double")
    told = told.withColumn("time", n * 0.1 + F.sin(n) * 0.001)
    r = (F.col("cell") % shape[2]) / F.lit(float(shape[2]))
    theta = F.floor(F.col("cell") / shape[2]) % shape[1] / F.lit(float(shape[1]))
    rho = F.exp(-r) * (1.5 + 0.2 * F.sin(F.col("time") + 6.283185307179586 * theta))
    return told.withColumn("rho", rho).withColumn("u", rho * (0.1 + 0.02 * F.cos(F.col("time") * 2 + r)))
