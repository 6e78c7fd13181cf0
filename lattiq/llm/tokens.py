"""Token-id files: concatenated ids with Elias-Fano document boundaries, written and read as whole shards.

Layout of a shard (little endian): ``LTQ1``, u8 bytes per id, u8 low bits, u16 zero,
u64 documents, u64 ids, u64 bytes of the high part, u64 bytes of the low part, the high part (unary
buckets, bit i + (x >> low) set for boundary i), the low part (packed), the ids.
Boundaries are the n + 1 offsets 0 .. ids, in about 2 + log2(ids / documents) bits each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import textscan as T
from .durable import Workspace
from .tokenize import encoder

HEAD = struct.Struct("<4sBBHQQQQ")
SHARD_IDS = 1 << 18


class EliasFano:
    """A non-decreasing sequence in near-minimal space with constant-time selection."""

    BLOCK = 64

    def __init__(self, count: int, low_bits: int, high: np.ndarray, low: np.ndarray):
        self.count, self.low_bits, self.high, self.low = count, low_bits, high, low
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        self._rank = ones[:: self.BLOCK // 8]
        self._last = ones[-1]

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = np.zeros(n + (top >> low_bits) + 1, np.uint8)
        bits[np.arange(n) + (values >> low_bits)] = 1
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel()
        return cls(n, low_bits, np.packbits(bits, bitorder="little"), np.packbits(low, bitorder="little"))

    def select(self, i: int) -> int:
        """The i-th value: a rank directory finds the block of the i-th set bit, a scan of 64 bits the bit."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        block = int(np.searchsorted(self._rank, i, "right")) - 1
        begin = block * self.BLOCK // 8
        ones = np.flatnonzero(np.unpackbits(self.high[begin : begin + self.BLOCK // 8], bitorder="little"))
        at = begin * 8 + int(ones[i - self._rank[block]])
        value = (at - i) << self.low_bits
        if self.low_bits:
            first = i * self.low_bits
            bits = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.low_bits]
            value |= int(bits @ (1 << np.arange(self.low_bits, dtype=np.int64)))
        return value

    def all(self) -> np.ndarray:
        """Every value, in one pass over the bits."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        high = (at - np.arange(self.count)) << self.low_bits
        low = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits].reshape(self.count, self.low_bits)
        return high + low.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


def pack_shard(documents: list[bytes], width: int) -> bytes:
    """A shard of documents given as packed ids of ``width`` bytes."""
    bounds = np.concatenate([[0], np.cumsum([len(d) // width for d in documents])]).astype(np.int64)
    index = EliasFano.of(bounds)
    head = HEAD.pack(b"LTQ1", width, index.low_bits, 0, len(documents), int(bounds[-1]), len(index.high), len(index.low))
    return b"".join([head, index.high.tobytes(), index.low.tobytes(), *documents])


def open_shard(payload) -> tuple[EliasFano, np.ndarray]:
    """(boundaries, ids) of a shard."""
    magic, width, low_bits, _, documents, ids, high, low = HEAD.unpack_from(payload)
    if magic != b"LTQ1":
        raise ValueError("not a token shard")
    at = HEAD.size
    index = EliasFano(documents + 1, low_bits, np.frombuffer(payload, np.uint8, high, at), np.frombuffer(payload, np.uint8, low, at + high))
    return index, np.frombuffer(payload, f"<u{width}", ids, at + high + low)


SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
SHARDS_SQL = "part int, seq int, before long, ids long, doc_ids array<long>, payload binary"


def shard_rows(vocabulary, end_id: int, special_as_text: bool):
    """Encode a partition's texts in their order and cut it into shards of about ``SHARD_IDS`` ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary.value, special_as_text)
        end = np.array([end_id], words.width).tobytes()
        width = words.width.itemsize
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        keys, documents, weight = [], [], 0

        def shard():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([weight]), pa.array([keys], pa.list_(pa.int64())), pa.array([pack_shard(documents, width)], pa.binary())], schema=SHARDS)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), words.encode_column(batch.column(1)), strict=True):
                keys.append(key)
                documents.append(ids + end)
                weight += len(ids) // width + 1
                if weight >= SHARD_IDS:
                    yield shard()
                    seq, before = seq + 1, before + weight
                    keys, documents, weight = [], [], 0
        if documents:
            yield shard()

    return T.lean(rows)


def write_tokens(docs: DataFrame, space: Workspace, name: str, vocabulary_file: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Write the token shards of ``docs`` in ascending id order (null first; equal ids by text hash).

    Texts are range-partitioned once, before they are encoded; partitions and the
    shards in them carry the global order.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_file).read_text("utf-8"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    return space.settle(ordered.mapInArrow(shard_rows(vocabulary, end_id, special_as_text), SHARDS_SQL), name)


def placed(shards: DataFrame) -> DataFrame:
    """Each shard with ``base``, the ids of all shards before it, and ``total``, all ids; one row per partition is broadcast."""
    sums = shards.groupBy("part").agg(F.sum("ids").alias("own"))
    order = Window.orderBy("part")
    parts = sums.select("part", (F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")).alias("ahead"), F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    return shards.join(F.broadcast(parts), "part").select("doc_ids", "payload", (F.col("ahead") + F.col("before")).alias("base"), "total")


def document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for keys, payload, base in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
            index, ids = open_shard(payload.as_buffer())
            bounds = index.all()
            wide = ids.astype("<u4")
            sums = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([keys.values, pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], schema=schema)


def token_index(docs: DataFrame, vocabulary_file: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Write token shards and read every document back: doc_id, start, n_tokens, ids_crc32.

    Each document is its text's ids and then ``end_id``; a null text counts as empty.
    ``start`` counts the ids of all documents before it, in ascending id order; null
    ids come first, and rows that share an id follow each other.  Names of special tokens in a text
    become their ids, as in a plain call of the library, unless ``special_as_text``.  A very long
    text is one shard of its own.  An empty table gives no rows.  Other columns are not read.
    """
    shards = write_tokens(docs, Workspace(docs.sparkSession, "tokens"), "shards", vocabulary_file, end_id, id_col=id_col, text_col=text_col, special_as_text=special_as_text)
    return placed(shards).select("doc_ids", "payload", "base").mapInArrow(document_rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
