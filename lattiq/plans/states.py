"""Whole runs over states under several schemes, and reports of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codec, schemes

KEYS = ["field", "block", "cell", "pos"]


def encode_states(states: DataFrame, folder: str, chosen: list[schemes.Scheme], stride: int, fields: tuple[str, ...], shape: tuple[int, int, int], log_fields: tuple[str, ...] = codec.N.LOG_FIELDS) -> None:
    """Write anchors, codes by scheme, sizes and errors of (field, block, cell, pos, time, value).

    The codes are made once and read back for sizes and errors, so what is reported is what was written.
    """
    states.filter(F.col("pos") % stride == 0).withColumn("gop", F.floor(F.col("pos") / stride)).write.parquet(f"{folder}/anchors")
    told = schemes.encode_schemes(schemes.field_residuals(states, stride, log_fields), chosen, fields, shape)
    lean = told.select("scheme", *KEYS, "gop", "time", "bits", "tile", "scale", "code", "exception", "prediction", "target", "value")
    lean.repartition("scheme", "field", "gop").sortWithinPartitions("scheme", "field", "gop", "pos", "cell").write.partitionBy("scheme").parquet(f"{folder}/codes")
    back = states.sparkSession.read.parquet(f"{folder}/codes")
    schemes.scheme_sizes(back).write.json(f"{folder}/sizes")
    scheme_report(back, log_fields).write.json(f"{folder}/errors")


def scheme_report(codes: DataFrame, log_fields: tuple[str, ...] = codec.N.LOG_FIELDS) -> DataFrame:
    """Error metrics by scheme and field."""
    rows = schemes.decode_schemes(codes, log_fields)
    return codec.metrics(codec.error_sums(rows, ["scheme", "field"], F.col("value"), F.col("reconstructed")), ["scheme", "field"])


def decode_states(spark: SparkSession, folder: str, scheme: str | None = None, log_fields: tuple[str, ...] = codec.N.LOG_FIELDS) -> DataFrame:
    """(field, block, cell, pos, time, reconstructed, exact) of one scheme: the one named, or the first by name."""
    codes = spark.read.parquet(f"{folder}/codes")
    name = scheme or codes.agg(F.min("scheme")).first()[0]
    middles = schemes.decode_schemes(codes.filter(F.col("scheme") == name), log_fields).select(*KEYS, "time", "reconstructed", F.lit(False).alias("exact"))
    anchors = spark.read.parquet(f"{folder}/anchors").select(*KEYS, "time", F.col("value").alias("reconstructed"), F.lit(True).alias("exact"))
    return middles.unionByName(anchors)


def comparison(frames: DataFrame, stride: int, strides: list[int], bits: int, percentile: float) -> DataFrame:
    """(channel, method, metrics) of the codec and of sparser cadences on the codec's middles."""
    last = frames.groupBy("channel").agg((F.floor(F.max("pos") / stride) * stride).alias("_last"))
    own = codec.decoded(codec.encoded(codec.predicted(codec.endpoint_join(frames, stride)), bits, percentile)).select("channel", F.lit("codec").alias("method"), "value", F.col("reconstructed").alias("estimate"))
    sparse = codec.cadence_interpolated(frames, strides).filter(F.col("pos") % stride != 0).join(last, "channel").filter(F.col("pos") < F.col("_last"))
    told = own.unionByName(sparse.select("channel", F.concat(F.lit("every_"), F.col("stride").cast("string")).alias("method"), "value", "estimate"))
    return codec.metrics(codec.error_sums(told, ["channel", "method"], F.col("value"), F.col("estimate")), ["channel", "method"])


def comparison_report(metrics: DataFrame) -> DataFrame:
    """(channel, report): one JSON object per channel, a member per method; there are as many members as methods."""
    columns = [c for c in metrics.columns if c not in ("channel", "method")]
    return metrics.groupBy("channel").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", F.struct(*columns).alias("m")))))).alias("report"))


def window_lists(frames: DataFrame, path: str, first: int, last: int) -> None:
    """Text lists of the paths and times of the frames ``first`` to ``last``, in order, for a program that reads such lists."""
    window = frames.filter(F.col("pos").between(first, last)).orderBy("pos")
    window.select(F.col("path").alias("value")).coalesce(1).write.text(f"{path}/paths")
    window.select(F.format_string("%.17g", "time").alias("value")).coalesce(1).write.text(f"{path}/times")


def layout(frame: DataFrame) -> DataFrame:
    """(column, type, nullable) of a table and the files it is made of, from the footers only."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, len(frame.inputFiles())) for f in frame.schema.fields]
    return frame.sparkSession.createDataFrame(rows, "column string, type string, nullable boolean, files int")
