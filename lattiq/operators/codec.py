"""Anchor-and-residual codec: endpoint prediction, scales, quantizing, reconstruction, error sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N


def endpoint_join(frames: DataFrame, stride: int) -> DataFrame:
    """Each middle frame with the start and end anchor of its group.

    An anchor goes to the group it starts and the one it ends, so one shuffle by (channel, gop) brings a group of at
    most ``stride`` + 1 frames together, and what is made of groups afterwards needs no other.
    Frames (channel, pos, time, value) behind the last anchor have no end and are left out.
    """
    gop = F.floor(F.col("pos") / stride)
    groups = F.when(F.col("pos") % stride == 0, F.array(gop, gop - 1)).otherwise(F.array(gop))
    dealt = frames.withColumn("gop", F.explode(groups))
    group = Window.partitionBy("channel", "gop")
    anchor = lambda k: F.max(F.when(F.col("pos") == (F.col("gop") + k) * stride, F.struct("time", "value"))).over(group)
    told = dealt.withColumn("_start", anchor(0)).withColumn("_end", anchor(1)).filter((F.col("pos") % stride != 0) & F.col("_start").isNotNull() & F.col("_end").isNotNull())
    told = told.select("*", F.col("_start.time").alias("start_time"), F.col("_start.value").alias("start_value"), F.col("_end.time").alias("end_time"), F.col("_end.value").alias("end_value")).drop("_start", "_end")
    return told.withColumn("tau", N.tau_of(F.col("time"), F.col("start_time"), F.col("end_time")))


def predicted(middles: DataFrame, log_space: bool = True) -> DataFrame:
    """Adds prediction and residual, in log space or as they are."""
    space = N.transformed if log_space else N.single
    told = middles.withColumn("prediction", N.predicted_line(space(F.col("start_value")), space(F.col("end_value")), F.col("tau")))
    return told.withColumn("residual", N.single(space(F.col("value")) - F.col("prediction")))


def _top(percentile: float) -> Column:
    return F.max(F.abs("residual")) if percentile >= 100 else F.percentile(F.abs("residual"), F.lit(percentile / 100))


def scales(residuals: DataFrame, keys: list[str], bits: int, percentile: float) -> DataFrame:
    """Scale of each group: exact percentile of the residual's size per code, rounded to single precision."""
    return residuals.groupBy(*keys).agg(F.greatest((_top(percentile) / N.top_code(bits)).cast("float").cast("double"), F.lit(N.EPS)).alias("scale"))


def encoded(residuals: DataFrame, bits: int = 8, percentile: float = 99.9, keys: tuple[str, ...] = ("channel", "gop")) -> DataFrame:
    """Adds scale, code and the exception (exact residual outside the code range) to residual rows; a group's scale is made where its rows are."""
    per_code = _top(percentile).over(Window.partitionBy(*keys)) / N.top_code(bits)
    told = residuals.withColumn("scale", F.greatest(per_code.cast("float").cast("double"), F.lit(N.EPS)))
    out = N.is_exception(F.col("residual"), F.col("scale"), bits, percentile)
    return told.withColumn("code", N.quantized(F.col("residual"), F.col("scale"), bits)).withColumn("exception", F.when(out, F.col("residual")))


def decoded(codes: DataFrame, log_space: bool = True) -> DataFrame:
    """Adds the dequantized residual and the reconstructed value."""
    told = codes.withColumn("dequantized", N.dequantized(F.col("code"), F.col("scale"), F.col("exception")))
    whole = N.single(F.col("prediction") + F.col("dequantized"))
    return told.withColumn("reconstructed", N.inverse_transformed(whole) if log_space else whole)


def error_sums(rows: DataFrame, keys: list[str], truth: Column, estimate: Column) -> DataFrame:
    """The mergeable sums from which every metric is made."""
    gap = estimate - truth
    return rows.groupBy(*keys).agg(
        F.sum(gap * gap).alias("sse"), F.sum(F.abs(gap)).alias("sae"), F.sum(truth * truth).alias("target_sse"), F.sum(F.abs(truth)).alias("target_abs"),
        F.count("*").alias("cnt"), F.min(estimate).alias("min_value"), F.max(F.abs(gap)).alias("max_abs_error"),
    )


def merged(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of sums; ratios are only ever made of these."""
    return sums.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("sse", "sae", "target_sse", "target_abs", "cnt")), F.min("min_value").alias("min_value"), F.max("max_abs_error").alias("max_abs_error"))


def metrics(sums: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """rmse, nrmse, rel_l1 of error sums."""
    floor = F.lit(N.EPS)
    return sums.select(
        *keys, "cnt", F.round(F.sqrt(F.col("sse") / F.greatest(F.col("cnt"), F.lit(1))), digits).alias("rmse"), F.round(F.sqrt(F.col("sse") / F.greatest("target_sse", floor)), digits).alias("nrmse"),
        F.round(F.col("sae") / F.greatest("target_abs", floor), digits).alias("rel_l1"), F.round("min_value", digits).alias("min_value"), F.round("max_abs_error", digits).alias("max_abs_error"),
    )


def cadence_interpolated(frames: DataFrame, strides: list[int]) -> DataFrame:
    """Every frame against the line between the anchors of a sparser cadence; anchors predict themselves.

    Each stride is a row of a small table, so one read of the frames serves all.
    """
    tagged = frames.withColumn("stride", F.explode(F.array(*(F.lit(s) for s in strides)))).withColumn("lower", F.floor(F.col("pos") / F.col("stride")) * F.col("stride"))
    # An anchor stands in its own stretch and at the end of the one before.
    ends = F.when(F.col("pos") == F.col("lower"), F.array(F.col("lower"), F.col("lower") - F.col("stride"))).otherwise(F.array("lower"))
    dealt = tagged.withColumn("lower", F.explode(ends))
    stretch = Window.partitionBy("channel", "stride", "lower")
    anchor = lambda at: F.max(F.when(F.col("pos") == at, F.struct("time", "value"))).over(stretch)
    told = dealt.withColumn("_low", anchor(F.col("lower"))).withColumn("_high", anchor(F.col("lower") + F.col("stride"))).filter(F.col("pos") < F.col("lower") + F.col("stride"))
    line = N.linear(F.col("_low.value"), F.col("_high.value"), N.tau_of(F.col("time"), F.col("_low.time"), F.col("_high.time")))
    return told.withColumn("estimate", F.when(F.col("pos") == F.col("lower"), F.col("value")).otherwise(line)).filter("estimate is not null").drop("_low", "_high")
