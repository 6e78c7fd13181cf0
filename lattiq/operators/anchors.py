"""Lossless anchors: differences of the bit patterns of single-precision states along time, packed with two checksums."""

from __future__ import annotations

import bz2
import lzma
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 2**32
PACKERS = {"bzip2": (lambda b: bz2.compress(b, 9), bz2.decompress), "xz": (lzma.compress, lzma.decompress)}


def _mapped(kind: str, f):
    """A function of single values as an Arrow-batched column function; nulls stay."""

    @F.pandas_udf(kind)
    def apply(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else f(v))

    return apply


def bits_of(values: Column) -> Column:
    """Unsigned bit patterns of single-precision values."""
    return _mapped("array<long>", lambda v: np.asarray(v, "<f4").view("<u4").astype(np.int64))(values)


def floats_of(bits: Column) -> Column:
    return _mapped("array<float>", lambda v: np.asarray(v, np.int64).astype("<u4").view("<f4"))(bits)


def _wrap(x: Column) -> Column:
    return F.pmod(x, F.lit(WORD))


def with_orders(anchors: DataFrame, interval: int) -> DataFrame:
    """Adds ``link`` (the stretch of ``interval`` anchors that decode from its first) and ``order`` (none, first, then second)."""
    told = anchors.withColumn("link", F.floor(F.col("gop") / interval))
    return told.withColumn("order", F.least(F.col("gop") % interval, F.lit(2)).cast("int"))


def differences(anchors: DataFrame, interval: int, values: str = "values") -> DataFrame:
    """Anchors (channel, gop, values) with ``bits`` and their modular ``delta``.  A stretch is one key of at most ``interval`` states; gaps in ``gop`` are errors."""
    line = Window.partitionBy("channel", "link").orderBy("gop")
    told = with_orders(anchors, interval).withColumn("bits", bits_of(F.col(values)))
    told = told.withColumn("_1", F.lag("bits", 1).over(line)).withColumn("_2", F.lag("bits", 2).over(line)).withColumn("_at", F.row_number().over(line) - 1)
    first = F.zip_with("bits", "_1", lambda a, b: _wrap(a - b))
    second = F.zip_with(F.zip_with("bits", "_1", lambda a, b: a - b), F.zip_with("_1", "_2", lambda b, c: b - c), lambda x, y: _wrap(x - y))
    delta = F.when(F.col("order") == 0, F.col("bits")).when(F.col("order") == 1, first).otherwise(second)
    whole = F.when(F.col("_at") == F.col("gop") % interval, delta).otherwise(F.raise_error(F.lit("an anchor of a stretch is missing")).cast("array<long>"))
    return told.withColumn("delta", whole).drop("_1", "_2", "_at")


def restored(deltas: DataFrame) -> DataFrame:
    """``bits`` again, from ``delta`` and ``order``: the stretch so far is folded in time order."""
    line = Window.partitionBy("channel", "link").orderBy("gop").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(F.struct("order", "delta")).over(line)
    empty = F.lit(None).cast("array<long>")
    start = F.struct(empty.alias("a"), empty.alias("b"))

    def step(state, row):
        one = F.zip_with(row["delta"], state["a"], lambda d, x: _wrap(d + x))
        two = F.zip_with(one, F.zip_with(state["a"], state["b"], lambda x, y: x - y), lambda p, q: _wrap(p + q))
        return F.struct(F.when(row["order"] == 0, row["delta"]).when(row["order"] == 1, one).otherwise(two).alias("a"), state["a"].alias("b"))

    return deltas.withColumn("bits", F.aggregate(seen, start, step)["a"])


def _packed(kind: str):
    pack = PACKERS[kind][0]
    return _mapped("binary", lambda d: pack(np.ascontiguousarray(np.asarray(d, np.int64).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()))


def _opened(kind: str):
    unpack = PACKERS[kind][1]
    return _mapped("array<long>", lambda p: np.frombuffer(np.ascontiguousarray(np.frombuffer(unpack(bytes(p)), np.uint8).reshape(4, -1).T).tobytes(), "<u4").astype(np.int64))


def target_crc(bits: Column) -> Column:
    """CRC-32 of a state's little-endian bytes."""
    return _mapped("long", lambda b: zlib.crc32(np.asarray(b, np.int64).astype("<u4").tobytes()))(bits)


def packed(anchors: DataFrame, interval: int, kind: str = "bzip2", values: str = "values") -> DataFrame:
    """(channel, gop, link, order, payload, crc_payload, crc_target): byte planes of the differences, compressed; states may not be empty."""
    told = differences(anchors, interval, values)
    told = told.select("channel", "gop", "link", "order", _packed(kind)("delta").alias("payload"), target_crc(F.col("bits")).alias("crc_target"))
    return told.withColumn("crc_payload", F.crc32("payload"))


def unpacked(stored: DataFrame, kind: str = "bzip2") -> DataFrame:
    """(channel, gop, values) of packed anchors; a payload or a state that does not match its checksum is an error."""
    ok = F.when(F.crc32("payload") == F.col("crc_payload"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its checksum")).cast("binary"))
    told = restored(stored.withColumn("delta", _opened(kind)(ok)))
    good = F.when(target_crc(F.col("bits")) == F.col("crc_target"), F.col("bits")).otherwise(F.raise_error(F.lit("a state does not match its checksum")).cast("array<long>"))
    return told.select("channel", "gop", floats_of(good).alias("values"))
