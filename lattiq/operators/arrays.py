"""Array states: channels, tiles, regions of interest, compact payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N


def cells(arrays: DataFrame, keys: list[str], column: str = "embedding") -> DataFrame:
    """Long form (keys, cell, value) of dense arrays."""
    return arrays.select(*keys, F.posexplode(column).alias("cell", "value")).withColumn("value", F.col("value").cast("double"))


def split_channels(arrays: DataFrame, keys: list[str], parts: int, length: int, name: str, column: str = "embedding") -> DataFrame:
    """Vector states as one scalar channel per component, ``name1`` .. ``nameN``."""
    pieces = F.array(*(F.struct(F.lit(f"{name}{k + 1}").alias("channel"), F.slice(column, k * length + 1, length).alias("vals")) for k in range(parts)))
    return arrays.select(*keys, F.explode(pieces).alias("c")).select(*keys, "c.channel", "c.vals")


def tile_scales(long: DataFrame, keys: list[str], shape: tuple[int, int, int], tile: tuple[int, int, int], bits: int, percentile: float) -> DataFrame:
    """Scale of each tile of each state."""
    told = long.withColumn("tile", N.tile_of(F.col("cell"), shape, tile))
    top = F.expr(f"percentile(abs(value), {percentile / 100})")
    return told.groupBy(*keys, "tile").agg(F.greatest((top / N.top_code(bits)).cast("float").cast("double"), F.lit(N.EPS)).alias("scale"))


def roi_prefix(arrays: DataFrame, keys: list[str], nr: int, stop: int, column: str = "embedding") -> DataFrame:
    """The first ``stop`` radial cells of every (phi, theta) line, in order."""
    return arrays.select(*keys, F.filter(F.transform(F.col(column), lambda x, i: F.when(i % nr < stop, x)), lambda x: x.isNotNull()).alias("vals"))


def remap_exceptions(exceptions: DataFrame, nr: int, stop: int) -> DataFrame:
    """Exception indexes (``idx``) inside the prefix, renumbered to it."""
    return exceptions.filter(F.col("idx") % nr < stop).withColumn("new_idx", F.floor(F.col("idx") / nr) * stop + F.col("idx") % nr)


def compact_payload(codes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: codes in order, scale, sorted exceptions; groups are as long as a group of pictures."""
    exceptions = F.array_sort(F.collect_list(F.when(F.col("exception").isNotNull(), F.struct(F.col("pos").alias("idx"), F.col("exception").alias("val")))))
    return codes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("codes"), F.max("scale").alias("scale"), exceptions.alias("exceptions"))


def payload_audit(payloads: DataFrame, bits: int, first: Column, last: Column) -> DataFrame:
    """Counts of violations: exception indexes that do not strictly ascend or leave ``first`` to ``last``, codes out of range, scales not finite or negative."""
    at = F.transform("exceptions", lambda x: x["idx"])
    ascending = F.forall(F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda later, x: later > x), lambda x: x)
    within = F.forall(at, lambda k: (k >= first) & (k <= last))
    inside = F.forall("codes", lambda c: F.abs(c) <= N.top_code(bits))
    finite = (F.col("scale") >= 0) & ~F.isnan("scale") & (F.col("scale") < float("inf"))
    return payloads.agg(F.count("*").alias("payloads"), F.count_if(~(ascending & within)).alias("bad_indexes"), F.count_if(~inside).alias("bad_codes"), F.count_if(~finite).alias("bad_scales"), F.sum(F.size("exceptions")).alias("exceptions"))


def derived_proxies(rho, u, speed_squared, field_squared):
    """Four derived fields of a state, as expressions."""
    return {
        "velocity_sq": speed_squared, "log_magnetic_pressure": F.ln(F.greatest(field_squared * 0.5, F.lit(N.EPS))),
        "log_magnetization": F.ln(F.greatest(field_squared, F.lit(N.EPS))) - F.ln(rho), "log_beta": F.ln(F.greatest(u * 2, F.lit(N.EPS))) - F.ln(F.greatest(field_squared, F.lit(N.EPS))),
    }
