"""Quantized states packed by channel and chunk of frames, with size and checksum on every member."""

from __future__ import annotations

import bz2
import lzma
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKERS = {"bzip2": (lambda b: bz2.compress(b, 9), bz2.decompress), "xz": (lzma.compress, lzma.decompress), "deflate": (lambda b: zlib.compress(b, 9), zlib.decompress)}
FOLDER = 256


def _differences(states: np.ndarray, order: int) -> np.ndarray:
    """A chunk's first state as it is, its second by first differences, the others by the order asked for; sums wrap."""
    out = states.copy()
    out[1:] -= states[:-1]
    if order == 2 and len(states) > 2:
        out[2:] = states[2:] - 2 * states[1:-1] + states[:-2]
    return out


def _sums(told: np.ndarray, order: int) -> np.ndarray:
    if order == 1 or len(told) < 3:
        return np.cumsum(told, axis=0, dtype=told.dtype)
    steps = np.cumsum(told[1:], axis=0, dtype=told.dtype)
    return np.concatenate([told[:1], told[:1] + np.cumsum(steps, axis=0, dtype=told.dtype)])


def _bytes(told: np.ndarray) -> bytes:
    """Zigzag codes in byte planes."""
    width = told.dtype.itemsize
    zigzag = ((told << 1) ^ (told >> (8 * width - 1))).astype(told.dtype)
    return np.ascontiguousarray(zigzag.reshape(-1).view(np.uint8).reshape(-1, width).T).tobytes()


def _states(data: bytes, width: int, frames: int) -> np.ndarray:
    unsigned = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").reshape(frames, -1)
    return ((unsigned >> 1) ^ (~(unsigned & 1) + 1)).view(f"<i{width}")


def _pack(kind: str):
    shrink = PACKERS[kind][0]

    @F.pandas_udf("order int, width int, payload binary")
    def apply(chunks: pd.Series) -> pd.DataFrame:
        rows = []
        for chunk in chunks:
            wide = np.stack([np.asarray(c, np.int64) for c in chunk])
            width = 1 if wide.size == 0 or np.abs(wide).max() <= 127 else 2
            states = wide.astype(f"<i{width}")
            tried = [(len(p), order, p) for order in (1, 2) for p in [shrink(_bytes(_differences(states, order)))]]
            size, order, payload = min(tried)
            rows.append((order, width, payload))
        return pd.DataFrame(rows, columns=["order", "width", "payload"])

    return apply


def _open(kind: str):
    grow = PACKERS[kind][1]

    @F.pandas_udf("array<array<int>>")
    def apply(order: pd.Series, width: pd.Series, frames: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([[row.astype("i4") for row in _sums(_states(grow(bytes(p)), w, n), o)] for o, w, n, p in zip(order, width, frames, payload, strict=True)])

    return apply


def packed(states: DataFrame, size: int, kind: str = "bzip2") -> DataFrame:
    """Members of states (channel, pos, codes array<int> of one length, at most 16 bits): one per channel and ``size`` frames.

    Each keeps the shorter of first and second differences, the first when equal.  A member holds ``size`` states and no more.
    """
    cut = states.withColumn("chunk", F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / size))
    chunks = cut.groupBy("channel", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "codes"))).alias("_c"))
    told = chunks.select("channel", "chunk", F.col("_c.pos").alias("positions"), _pack(kind)(F.col("_c.codes")).alias("_p"))
    told = told.select("channel", "chunk", "positions", F.lit(size).alias("chunk_frames"), F.lit(kind).alias("codec"), "_p.*")
    return told.withColumn("bytes", F.octet_length("payload")).withColumn("crc32", F.crc32("payload"))


def unpacked(members: DataFrame, kind: str = "bzip2") -> DataFrame:
    """(channel, pos, codes) of members; one whose size or checksum is not the recorded one is an error."""
    whole = (F.octet_length("payload") == F.col("bytes")) & (F.crc32("payload") == F.col("crc32")) & (F.col("codec") == kind)
    sound = F.when(whole, F.col("payload")).otherwise(F.raise_error(F.lit("a member does not match its size, codec or checksum")).cast("binary"))
    told = members.withColumn("_s", _open(kind)("order", "width", F.size("positions"), sound))
    return told.select("channel", F.explode(F.arrays_zip("positions", "_s")).alias("f")).select("channel", F.col("f.positions").alias("pos"), F.col("f._s").alias("codes"))


def damaged(members: DataFrame) -> DataFrame:
    """Members whose payload is not as recorded."""
    return members.filter((F.octet_length("payload") != F.col("bytes")) | (F.crc32("payload") != F.col("crc32"))).select("channel", "chunk")


def write_members(members: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Folders hold runs of chunks, files are sorted by channel and chunk, so a reader of few frames opens few row groups."""
    cut = members.withColumn("chunk_folder", F.floor(F.col("chunk") / FOLDER))
    cut.repartition("chunk_folder", "channel").sortWithinPartitions("channel", "chunk").write.mode(mode).partitionBy("chunk_folder").parquet(path)


def read_frames(spark: SparkSession, path: str, positions: list[int], size: int, kind: str = "bzip2", channels: list[str] | None = None) -> DataFrame:
    """Chosen frames; only their members are read, by folder and by row group."""
    wanted = sorted({max(p - 1, 0) // size for p in positions})
    found = spark.read.parquet(path).filter(F.col("chunk_folder").isin(sorted({c // FOLDER for c in wanted})) & F.col("chunk").isin(wanted))
    if channels is not None:
        found = found.filter(F.col("channel").isin(channels))
    return unpacked(found, kind).filter(F.col("pos").isin(positions))


def repacked(members: DataFrame, size: int, kind: str, old_kind: str = "bzip2") -> DataFrame:
    """The same states in members of another length or codec."""
    return packed(unpacked(members, old_kind), size, kind)


def transcoded(members: DataFrame, kind: str = "deflate", old_kind: str = "bzip2") -> DataFrame:
    """The same members in a codec that opens faster; differences stay as they are."""
    grow, shrink = PACKERS[old_kind][1], PACKERS[kind][0]

    @F.pandas_udf("binary")
    def other(payload: pd.Series) -> pd.Series:
        return payload.map(lambda p: shrink(grow(bytes(p))))

    sound = F.when((F.crc32("payload") == F.col("crc32")) & (F.col("codec") == old_kind), F.col("payload")).otherwise(F.raise_error(F.lit("a member does not match its codec or checksum")).cast("binary"))
    told = members.withColumn("payload", other(sound)).withColumn("codec", F.lit(kind))
    return told.withColumn("bytes", F.octet_length("payload")).withColumn("crc32", F.crc32("payload"))
