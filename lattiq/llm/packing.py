"""Packing: concatenate all documents' ids and cut the stream into fixed windows.

Ids are written once as ordered shards.  Partition totals, summed over the
partitions before, give every shard its place in the stream, so windows are cut
where they fall without moving ids; each piece of a document inside a window is a
boundary record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .durable import Workspace
from .tokens import open_shard, placed, write_tokens

LENGTH = 4096


def piece_rows(length: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"))]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, payload, base, total in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                index, ids = open_shard(payload.as_buffer())
                bounds = index.all()
                wide = ids.astype("<u4")
                # Cuts fall at document ends and at multiples of the window length.
                inner = np.arange(base // length * length + length, base + int(bounds[-1]), length) - base
                cuts = np.union1d(bounds, inner[(inner > 0) & (inner < bounds[-1])])
                begin, end = cuts[:-1], cuts[1:]
                of = np.searchsorted(bounds, begin, "right") - 1
                window = (begin + base) // length
                left = total - window * length
                tail = (left < length) & (left & (left - 1) == 0)
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                columns = [keys.values.take(pa.array(of)), begin - bounds[of], end - begin, np.array(sums, np.int64), np.diff(bounds)[of], window, (begin + base) % length, np.where(tail, left, length)]
                columns = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(wide.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return T.lean(rows)


def pack(docs: DataFrame, vocabulary_file: str, *, end_id: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length (and ids).

    Documents follow each other by ascending id (null first), each with ``end_id``
    after its ids; a null or empty text is that one id.  Only the last sequence can
    be short; it is padded to ``length`` unless it already ends at a power of two.
    Repeated ids and rows are packed as often as they come; a very long text fills as many sequences
    as it needs, and an empty table gives no rows.  Names of special tokens in a text become their
    ids unless ``special_as_text``.  Other columns are not read.
    """
    shards = write_tokens(docs, Workspace(docs.sparkSession, "packing"), "shards", vocabulary_file, end_id, id_col=id_col, text_col=text_col, special_as_text=special_as_text)
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
    return placed(shards).mapInArrow(piece_rows(length, with_ids), out + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame, pad_id: int = 0) -> DataFrame:
    """Padded sequences of pieces that carry ids: sequence_id, ids, used.  A sequence gathers at most its own length of ids."""
    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("all"), F.max("padded_length").alias("padded"))
    ids = F.flatten(F.transform("all", lambda x: x["ids"]))
    return joined.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), F.col("padded").cast("int") - F.size(ids))).alias("ids"), F.size(ids).alias("used"))
