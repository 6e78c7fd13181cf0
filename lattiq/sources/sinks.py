"""Tables that the codec writes: residual archives, anchors, manifests, slabs, retained frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import mebibytes


def write_archive(codes: DataFrame, path: str, mode: str = "errorifexists", groups_per_folder: int = 64) -> None:
    """Codes clustered by channel and group; a coarse folder of groups serves pruning without a folder for each."""
    cut = codes.withColumn("gop_folder", F.floor(F.col("gop") / groups_per_folder))
    cut.repartition("gop_folder", "channel").sortWithinPartitions("channel", "gop", "pos").write.mode(mode).partitionBy("gop_folder").parquet(path)


def write_anchors(frames: DataFrame, stride: int, path: str, mode: str = "errorifexists") -> None:
    """Exact anchors; an existing table is only replaced when asked."""
    frames.filter(F.col("pos") % stride == 0).withColumn("gop", F.floor(F.col("pos") / stride)).write.mode(mode).parquet(path)


def write_slabs(long: DataFrame, path: str, slab: int, nr: int, mode: str = "errorifexists") -> None:
    """Cells in radial slabs, sorted so that a reader of the inner ones skips the others."""
    cut = long.withColumn("slab_begin", F.floor(F.col("cell") % nr / slab) * slab)
    cut.repartitionByRange("slab_begin").sortWithinPartitions("slab_begin", "cell").write.mode(mode).option("compression", "lz4_raw").parquet(path)


def read_region(slabs: DataFrame, stop: int) -> DataFrame:
    """Cells of the slabs that begin before ``stop``; the condition reaches the scan."""
    return slabs.filter(F.col("slab_begin") < stop)


def write_manifest(codes: DataFrame, path: str, config: dict, mode: str = "errorifexists", groups_per_folder: int = 64) -> None:
    """One JSON document per channel and folder of groups: groups with frames, exceptions and scale, and the configuration.  A document holds at most ``groups_per_folder`` groups."""
    groups = codes.groupBy("channel", "gop").agg(F.count("*").alias("frames"), F.count("exception").alias("exceptions"), F.min("scale").alias("scale"))
    told = groups.groupBy("channel", F.floor(F.col("gop") / groups_per_folder).alias("gop_folder")).agg(F.sum("frames").alias("frames"), F.array_sort(F.collect_list(F.struct("gop", "frames", "exceptions", "scale"))).alias("gops"))
    settings = F.create_map(*[F.lit(str(x)) for kv in config.items() for x in kv])
    told.withColumn("configuration", settings).write.mode(mode).json(path)


def write_restored(decoded: DataFrame, path: str, provenance: dict[str, str], mode: str = "errorifexists") -> None:
    """Reconstructed frames in the columns of frames, with where they come from."""
    told = decoded.select("channel", "pos", "time", F.col("reconstructed").alias("value"))
    for key, value in provenance.items():
        told = told.withColumn(key, F.lit(value))
    told.write.mode(mode).parquet(path)


def storage_report(sizes: DataFrame) -> DataFrame:
    """(kind, MiB, files) of a table of file sizes (kind, size_bytes)."""
    return sizes.groupBy("kind").agg(F.round(mebibytes(F.sum("size_bytes")), 3).alias("mib"), F.count("*").alias("files"))
