"""Vectorised scanning of whole texts: words, lines and range hashes straight from Arrow buffers.

A text column is read without making one Python string per row.  Work is done on
runs of whole documents of about a megabyte, so memory does not depend on the
batch, and one long document is simply a run of its own.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 19
U64 = np.uint64

_rng = np.random.default_rng(20_240_229)
_EXACT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_BASE = int(_rng.integers(1, 2**61)) * 8 + 5
_BACK = pow(_BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def lean(rows: Callable) -> Callable:
    """``rows`` for ``mapInArrow``, after which a worker gives the memory it no longer needs back to the system; workers are reused."""

    @functools.wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 2 * max(RUN_BYTES, n)
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Run:
    """Consecutive documents ``first .. first+len(offsets)-1`` of a batch; ``data[offsets[i]:offsets[i+1]]`` is one text."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return len(self.offsets) - 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    elif pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        return text_buffers(column.cast(pa.large_string()))
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[Run]:
    data, offsets = text_buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Run(at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


def range_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each ``data[begin:end]``; ``fold`` takes A-Z as a-z."""
    ahead, back = _tables(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_FOLDED if fold else _EXACT)[data] * ahead[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def pieces(apart: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches where ``apart`` is false, never across documents: (begin, end, index of each document's first)."""
    n = len(apart)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~apart
    up = inside[1:-1] > inside[:-2]
    down = inside[1:-1] > inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    up[edges] |= inside[1:-1][edges] > 0
    down[edges - 1] |= inside[1:-1][edges - 1] > 0
    begin = np.flatnonzero(up)
    return begin, np.flatnonzero(down) + 1, np.searchsorted(begin, offsets)


def words(run: Run, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, and for each document the index of its first (one more at the end)."""
    begin, end, first = pieces(SPACE[run.data], run.offsets)
    return range_hash(run.data, begin, end, fold), first


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive word hashes."""
    out = hashes[: max(0, len(hashes) - width + 1)].copy()
    for k in range(1, width):
        out = out * U64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's windows of ``width`` words (all its words as one window, if it has fewer) and their first indexes."""
    counts = np.diff(first)
    whole = chain(hashes, width)
    of = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    start = np.concatenate([[0], np.cumsum(sizes)])
    if not (short := np.flatnonzero((counts > 0) & (counts < width))).size:
        return whole[np.arange(len(of)) - start[of] + first[of]], start
    out = np.empty(start[-1], np.uint64)
    long = np.flatnonzero(counts >= width)
    if long.size:
        at = np.arange(len(of)) + np.repeat((start[:-1] - np.cumsum(np.maximum(counts - width + 1, 0)) + np.maximum(counts - width + 1, 0))[long], sizes[long])
        out[at] = whole[at - start[of] + first[of]]
    for k in short:
        own = hashes[first[k] : first[k + 1]]
        out[start[k]] = chain(own, len(own))[0]
    return out, start


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def blobs(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())
