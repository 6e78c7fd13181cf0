"""Frame files by listing: numbers, strides, cached indexes, manifests.  Contents are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parameters import sequence_of


def files(spark: SparkSession, folder: str, pattern: str = "*.phdf") -> DataFrame:
    """(path, size_bytes, modified) of the files below a folder that hold anything."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def sequence_files(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Numbered frame files between two numbers, both included; fewer than three are an error."""
    found = files(spark, folder).withColumn("sequence", sequence_of(F.col("path"))).filter("sequence is not null")
    if first is not None:
        found = found.filter(F.col("sequence") >= first)
    if last is not None:
        found = found.filter(F.col("sequence") <= last)
    if found.limit(3).count() < 3:
        raise ValueError(f"fewer than three frame files in {folder}")
    return found


def strided_files(spark: SparkSession, folder: str, stride: int, pattern: str = "*") -> DataFrame:
    """Raw output files whose own number divides by ``stride``; names without number are skipped, equal numbers rejected."""
    found = files(spark, folder, pattern).withColumn("sequence", sequence_of(F.col("path"), "raw")).filter(F.col("sequence") % stride == 0)
    if not found.groupBy("sequence").count().filter("count > 1").isEmpty():
        raise ValueError("two files have the same number")
    return found


def same_index(stored: DataFrame, listed: DataFrame) -> bool:
    """Whether a stored index still names exactly the files there are (path, size, time)."""
    one, two = (x.select("path", "size_bytes", "modified") for x in (stored, listed))
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def manifest_frames(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, time, path, size_bytes, exact_keyframe) of a manifest with ``frames``."""
    schema = "frames array<struct<sequence:long,time:double,path:string,size_bytes:long,exact_keyframe:boolean>>"
    told = spark.read.schema(schema).json(path, multiLine=True)
    if told.filter("frames is not null").isEmpty():
        raise ValueError(f"no frames in {path}")
    return told.select(F.explode("frames").alias("f")).select("f.*")


def checked_index(frames: DataFrame) -> DataFrame:
    """A frame index as it must be: rows, unique numbers, times that rise with them."""
    if frames.isEmpty():
        raise ValueError("an index needs frames")
    if not frames.groupBy("sequence").count().filter("count > 1").isEmpty():
        raise ValueError("a number comes twice")
    if not frames.groupBy("time").count().filter("count > 1").isEmpty():
        raise ValueError("two frames have the same time")
    return frames
