"""Parameter files, path names and scheme configuration as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Fixed formats: numbers in the names of frame files and of raw output, and members of archives.
FRAME_NUMBER = r"\.out0\.(\d+)\.phdf$"
RAW_NUMBER = r"\.out\d+\.(\d+)\."
MEMBER = "frames/%05d/%s_{suffix}.npy"


def sequence_of(path: Column, kind: str = "frame") -> Column:
    """Number in a path's name (``.out0.N.phdf`` for frames, ``.outK.N.`` for raw output); null where there is none."""
    found = F.regexp_extract(path, FRAME_NUMBER if kind == "frame" else RAW_NUMBER, 1)
    return F.when(found != "", found.cast("long"))


def member_name(frame: Column, field: Column, suffix: str) -> Column:
    return F.format_string(MEMBER.format(suffix=suffix), frame.cast("int"), F.regexp_replace(field, r"[^A-Za-z0-9_]", "_"))


def normal_key(key: Column) -> Column:
    """Option names and file keys alike: no leading dashes, underscores inside."""
    return F.regexp_replace(F.regexp_replace(F.trim(key), "^--", ""), "-", "_")


def read_parameters(lines: DataFrame) -> DataFrame:
    """(file, line_no, section, key, value) of ``key=value`` or ``key value`` lines (file, line_no, text); # starts a comment.

    A section heading ``<name>`` holds until the next one of its file.
    """
    bare = lines.withColumn("text", F.trim(F.regexp_replace("text", "#.*$", ""))).filter("text <> ''")
    heading = F.regexp_extract("text", r"^<([^>]+)>$", 1)
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    told = bare.withColumn("section", F.last(F.when(heading != "", heading), ignorenulls=True).over(order)).filter(heading == "")
    split = F.split("text", r"\s*=\s*|\s+", 2)
    return told.select("file", "line_no", "section", normal_key(split[0]).alias("key"), F.trim(F.get(split, F.lit(1))).alias("value"))


def effective_parameters(parameters: DataFrame) -> DataFrame:
    """(section, key, value) after all files in order of ``rank``; the last wins."""
    return parameters.groupBy("section", "key").agg(F.max_by("value", F.struct("rank", "line_no")).alias("value"))


def rewritten(text: str, section: str, changes: dict[str, str]) -> str:
    """A parameter text with values of one section replaced; every key must be there."""
    out, here, left = [], None, dict(changes)
    for line in text.splitlines():
        if found := re.match(r"\s*<([^>]+)>", line):
            here = found[1]
        key = line.split("=")[0].strip()
        if here == section and "=" in line and key in left:
            line = f"{key} = {left.pop(key)}"
        out.append(line)
    if left:
        raise KeyError(f"not in <{section}>: {', '.join(sorted(left))}")
    return "\n".join(out) + "\n"


def scheme_config(bits: dict[str, int], percentiles: dict[str, float], tiles: dict[str, tuple[int, int, int]], fields: tuple[str, ...]) -> None:
    """Raise on unknown fields and values out of range."""
    for name, value in bits.items():
        if name not in fields or not 4 <= value <= 16:
            raise ValueError(f"bits of {name}: {value}")
    for name, value in percentiles.items():
        if name not in fields or not 0 < value <= 100:
            raise ValueError(f"percentile of {name}: {value}")
    for name, value in tiles.items():
        if name not in fields or len(value) != 3 or min(value) < 1:
            raise ValueError(f"tile of {name}: {value}")


def identity_token(*columns: Column) -> Column:
    """SHA-256 of a source's identity (path, size, modification time)."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text) of text files, one file to a row group."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "text"))
    return whole
