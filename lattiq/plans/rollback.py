"""A run taken back to a checkpoint: what is kept is written to a new folder, what goes is listed in an audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import runs
from .sequence import LOCAL, Profile


def checked(checkpoint: dict, stride: int) -> int:
    """The number of the last frame before a checkpoint; it needs ghost zones and the end of a group."""
    last = checkpoint.get("last_sequence")
    if last is None or last < 0:
        raise ValueError("a checkpoint needs the number of its last frame")
    if not checkpoint.get("includes_ghost"):
        raise ValueError("a checkpoint without ghost zones cannot be continued")
    if last % stride:
        raise ValueError(f"frame {last} does not end a group of {stride}")
    return last


def divided(spark: SparkSession, folder: str, to_pos: int, stride: int) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(kept, removed) of each table of a run: groups that end at or before ``to_pos``, anchors and retained frames up to it."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    rules = {"codes": (F.col("gop") + 1) * stride <= to_pos, "anchors": F.col("pos") <= to_pos}
    if runs._exists(spark, f"{folder}/retained"):
        rules["retained"] = F.col("pos") <= to_pos
    return {name: (read(name).filter(rule), read(name).filter(~rule)) for name, rule in rules.items()}


def rollback(spark: SparkSession, folder: str, target: str, checkpoint: dict, profile: Profile = LOCAL, history: DataFrame | None = None, history_rows: int | None = None) -> None:
    """Write the run as it was at a checkpoint to ``target`` with history cut to ``history_rows`` data lines and an ``audit`` table.

    The old run is not touched.  Audit rows are counts by table and channel of what was kept and removed, so they do not grow with the frames.
    """
    if runs._exists(spark, target):
        raise ValueError(f"{target} exists")
    to_pos = checked(checkpoint, profile.stride)
    trail = []
    for name, (kept, removed) in divided(spark, folder, to_pos, profile.stride).items():
        parts = ["gop_folder"] if "gop_folder" in kept.columns else []
        kept.write.partitionBy(*parts).parquet(f"{target}/{name}")
        for side, rows in (("kept", kept), ("removed", removed)):
            trail.append(rows.groupBy("channel").agg(F.count("*").alias("frames"), F.min("pos").alias("first"), F.max("pos").alias("last")).select(F.lit(name).alias("part"), F.lit(side).alias("side"), "*"))
    if history is not None:
        runs.truncated_history(history, history_rows if history_rows is not None else to_pos + 1).write.parquet(f"{target}/history")
    told = trail[0]
    for more in trail[1:]:
        told = told.unionByName(more)
    told.select("*", F.lit(to_pos).alias("to_pos"), F.lit(folder).alias("source"), F.lit(checkpoint.get("path")).cast("string").alias("checkpoint"), F.current_timestamp().alias("at")).write.json(f"{target}/audit")
