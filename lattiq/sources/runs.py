"""What lies around a run: checkpoint records, history segments, integrity tables, a marker for finished runs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parameters import read_parameters
from ..operators import checkpoints
from ..operators.lifecycle import allocation

# Fixed names: the sections of a parameter file that hold a mesh, and the keys of its sizes.
MESH, BLOCK, SIZES = "parthenon/mesh", "parthenon/meshblock", ("nx1", "nx2", "nx3")


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint records of JSON files, one object a line: the attributes and ``input``, the embedded parameter text.

    Mesh and block sizes come from the text where the record has none.  Records without a time or a number are left as
    they are, with nulls; what needs them filters.
    """
    found = spark.read.schema(checkpoints.FIELDS + ", input string").json(path)
    lines = found.select(F.col("path").alias("file"), F.posexplode(F.split("input", "\n")).alias("line_no", "text"))
    given = read_parameters(lines).filter(F.col("section").isin(MESH, BLOCK) & F.col("key").isin(*SIZES))
    sizes = lambda section: F.array(*(F.max(F.when((F.col("section") == section) & (F.col("key") == k), F.col("value").cast("int"))) for k in SIZES))
    told = given.groupBy(F.col("file").alias("path")).agg(sizes(MESH).alias("_mesh"), sizes(BLOCK).alias("_block"))
    whole = lambda name: F.coalesce(F.col(name.removeprefix("_")), F.when(F.forall(name, lambda x: x.isNotNull()), F.col(name)))
    return found.join(told, "path", "left").withColumn("mesh", whole("_mesh")).withColumn("block", whole("_block")).drop("_mesh", "_block")


def read_history(spark: SparkSession, folder: str, combined: str = "combined.hst") -> DataFrame:
    """(segment, line_no, text, is_comment) of history files, in order of their names; the combined file is not a segment.

    A file is one row while it is split, as history segments are a line per cycle.
    """
    whole = spark.read.text(folder, wholetext=True, pathGlobFilter="*.hst").select(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("segment"), "value")
    lines = whole.filter(F.col("segment") != combined).select("segment", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "text"))
    return lines.filter("trim(text) <> ''").withColumn("is_comment", F.col("text").startswith("#"))


def truncated_history(history: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` data lines over all segments, and the comments of the first; lines are numbered inside segments only."""
    data = history.filter(~F.col("is_comment"))
    counts = data.groupBy("segment").agg(F.count("*").alias("rows")).withColumn("_all", F.lit(0))
    kept = allocation(counts, ["_all"], "segment", "rows", limit).select("segment", "kept")
    rank = F.row_number().over(Window.partitionBy("segment").orderBy("line_no"))
    rows = data.withColumn("_rank", rank).join(kept, "segment").filter(F.col("_rank") <= F.col("kept")).select(*history.columns)
    first = history.agg(F.min("segment").alias("_first"))
    heads = history.filter("is_comment").join(F.broadcast(first), F.col("segment") == F.col("_first")).select(*history.columns)
    return heads.unionByName(rows)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, sha256, crc32) of a folder's data files; names are relative, so a moved run still verifies.  A part file is one row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{parquet,json}").load(folder)
    return found.select(F.substring_index("path", "/", -2).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.crc32("content").alias("crc32"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def finalize(spark: SparkSession, folder: str, frames: DataFrame) -> None:
    """Finish an encoded run: every frame (channel, pos) up to each series' last whole group has to be there, then digests and the marker are written.

    A run that lacks frames stays open and is an error; finishing twice is one too.
    """
    if _exists(spark, f"{folder}/finished"):
        raise ValueError(f"{folder} is finished")
    codes, anchors = spark.read.parquet(f"{folder}/codes"), spark.read.parquet(f"{folder}/anchors")
    last = anchors.groupBy("channel").agg(F.max("pos").alias("last"))
    there = codes.select("channel", "pos").unionByName(anchors.select("channel", "pos"))
    lost = frames.select("channel", "pos").join(last, "channel").filter("pos <= last").join(there, ["channel", "pos"], "left_anti")
    missing = lost.count()
    if missing:
        raise ValueError(f"{missing} frames are missing in {folder}")
    parts = [file_digests(spark, f"{folder}/{p}").withColumn("part", F.lit(p)) for p in ("codes", "anchors")]
    parts[0].unionByName(parts[1]).write.parquet(f"{folder}/integrity")
    told = there.groupBy("channel").agg(F.count("*").alias("frames"), F.max("pos").alias("last")).withColumn("finished_at", F.current_timestamp())
    told.write.json(f"{folder}/finished")


def integrity_errors(spark: SparkSession, folder: str) -> DataFrame:
    """(part, name, error) of files that changed, went or came since the run was finished."""
    recorded = spark.read.parquet(f"{folder}/integrity").select("part", "name", F.col("sha256").alias("old"), F.col("crc32").alias("old_crc"))
    parts = [file_digests(spark, f"{folder}/{p}").withColumn("part", F.lit(p)) for p in ("codes", "anchors")]
    both = recorded.join(parts[0].unionByName(parts[1]), ["part", "name"], "full")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("old").isNull(), "unexpected").when((F.col("old") != F.col("sha256")) | (F.col("old_crc") != F.col("crc32")), "changed")
    return both.select("part", "name", fault.alias("error")).filter("error is not null")


def wait_finished(spark: SparkSession, folder: str, timeout: float, poll: float = 1.0) -> DataFrame:
    """The marker of a run, as soon as a stream has finished it; an error after ``timeout`` seconds."""
    until = time.monotonic() + timeout
    while not _exists(spark, f"{folder}/finished/_SUCCESS"):
        if time.monotonic() >= until:
            raise TimeoutError(f"{folder} was not finished in {timeout} s")
        time.sleep(min(poll, max(until - time.monotonic(), 0.01)))
    return spark.read.json(f"{folder}/finished")
