"""Zipped and plain array members as rows."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

SCHEMA = pa.schema([("path", pa.string()), ("member", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("crc32", pa.int64()), ("payload", pa.binary())])
SQL = "path string, member string, dtype string, shape array<long>, crc32 long, payload binary"


def array_member(data: bytes) -> tuple[np.dtype, tuple[int, ...], bytes]:
    """(dtype, shape, C-ordered bytes) of an NPY member; objects and wrong sizes are errors."""
    stream = io.BytesIO(data)
    version = np.lib.format.read_magic(stream)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version]
    shape, fortran, dtype = read(stream)
    if dtype.hasobject:
        raise ValueError("object arrays are not read")
    body = data[stream.tell() :]
    if len(body) != dtype.itemsize * int(np.prod(shape, dtype=np.int64)):
        raise ValueError("a member has the wrong size")
    if fortran:
        body = np.frombuffer(body, dtype).reshape(shape, order="F").tobytes("C")
    return dtype, shape, body


def member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                for name in archive.namelist():
                    data = archive.read(name)  # the archive's own checksum is held against it
                    dtype, shape, body = (np.dtype("u1"), (len(data),), data) if not name.endswith(".npy") else array_member(data)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([dtype.str]), pa.array([list(shape)], pa.list_(pa.int64())), pa.array([zlib.crc32(data)]), pa.array([body], pa.binary())], schema=SCHEMA)


def read_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """Every member of every archive: path, member, dtype, shape, crc32, payload (C order)."""
    ship(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "content").mapInArrow(member_rows, SQL)
