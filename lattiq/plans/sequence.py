"""Whole runs: encode a sequence to tables, read it back, compare it with sparser cadences, verify it."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, codec
from ..sources import sinks


@dataclass(frozen=True)
class Profile:
    """Settings of a run."""

    stride: int = 25
    bits: int = 8
    percentile: float = 99.9
    log_space: bool = True


LOCAL = Profile()


def encode(frames: DataFrame, folder: str, profile: Profile = LOCAL) -> None:
    """Write anchors, codes and manifest of (channel, pos, time, value).  Groups are keys, so all are encoded at once."""
    told = codec.encoded(codec.predicted(codec.endpoint_join(frames, profile.stride), profile.log_space), profile.bits, profile.percentile)
    lean = told.select("channel", "gop", "pos", "time", "tau", "scale", "code", "exception")
    sinks.write_anchors(frames, profile.stride, f"{folder}/anchors")
    sinks.write_archive(lean, f"{folder}/codes")
    sinks.write_manifest(frames.sparkSession.read.parquet(f"{folder}/codes"), f"{folder}/manifest", asdict(profile))


def decode(spark: SparkSession, folder: str, profile: Profile = LOCAL, positions: list[int] | None = None) -> DataFrame:
    """(channel, pos, time, reconstructed, exact) of a written run; only the folders of the wanted frames are read."""
    codes, anchors = spark.read.parquet(f"{folder}/codes"), spark.read.parquet(f"{folder}/anchors")
    if positions is not None:
        groups = sorted({p // profile.stride for p in positions})
        codes = codes.filter(F.col("gop_folder").isin(sorted({g // 64 for g in groups})) & F.col("pos").isin(positions))
        anchors = anchors.filter(F.col("gop").isin(sorted({g + k for g in groups for k in (0, 1)})))
    start = anchors.select("channel", "gop", F.col("value").alias("a"))
    end = anchors.select("channel", (F.col("gop") - 1).alias("gop"), F.col("value").alias("b"))
    space = codec.N.transformed if profile.log_space else codec.N.single
    told = codes.join(start, ["channel", "gop"]).join(end, ["channel", "gop"]).withColumn("prediction", codec.N.predicted_line(space(F.col("a")), space(F.col("b")), F.col("tau")))
    middles = codec.decoded(told, profile.log_space).select("channel", "pos", "time", "reconstructed", F.lit(False).alias("exact"))
    exact = anchors.select("channel", "pos", "time", F.col("value").alias("reconstructed"), F.lit(True).alias("exact"))
    return middles.unionByName(exact if positions is None else exact.filter(F.col("pos").isin(positions)))


def verify(spark: SparkSession, folder: str, frames: DataFrame) -> DataFrame:
    """(check, failures): frames missing or too many, codes that are not finite, anchors that changed."""
    back = decode(spark, folder)
    lost = frames.filter("pos >= 0").select("channel", "pos").join(back.select("channel", "pos"), ["channel", "pos"], "left_anti")
    odd = audit.finite(back, ["channel"], "reconstructed").agg(F.sum("non_finite").alias("failures"))
    moved = frames.join(back.filter("exact").select("channel", "pos", "reconstructed"), ["channel", "pos"]).filter("value <> reconstructed")
    count = lambda frame, name: frame.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
    return count(lost, "missing").unionByName(odd.select(F.lit("not finite").alias("check"), "failures")).unionByName(count(moved, "anchors"))
