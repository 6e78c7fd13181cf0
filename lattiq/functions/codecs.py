"""Byte codecs of stored members: compression and byte planes, in Arrow batches."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_PACK: dict[str, Callable[[bytes], bytes]] = {"bzip2": lambda b: bz2.compress(b, 9), "xz": lambda b: lzma.compress(b), "deflate": lambda b: zlib.compress(b, 9)}
_OPEN: dict[str, Callable[[bytes], bytes]] = {"bzip2": bz2.decompress, "xz": lzma.decompress, "deflate": zlib.decompress}


def _each(f: Callable[[bytes], bytes]):
    @F.pandas_udf("binary")
    def apply(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else f(bytes(b)))

    return apply


def compressed(column, kind: str):
    return _each(_PACK[kind])(column)


def decompressed(column, kind: str):
    return _each(_OPEN[kind])(column)


def _planes(data: bytes, size: int, back: bool) -> bytes:
    if len(data) % size:
        raise ValueError("a payload is not a whole number of items")
    shape = (size, -1) if back else (-1, size)
    return np.frombuffer(data, np.uint8).reshape(shape).T.tobytes() if data else b""


def byte_planes(column, itemsize: int):
    """All first bytes, then all second ones, and so on."""
    return _each(lambda b: _planes(b, itemsize, False))(column)


def from_byte_planes(column, itemsize: int):
    return _each(lambda b: _planes(b, itemsize, True))(column)


def checked(payload, crc):
    """The payload, or an error where its CRC-32 is not the stored one."""
    return F.when(F.crc32(payload) == crc, payload).otherwise(F.raise_error(F.lit("a payload does not match its checksum")))
