"""Document fingerprints by consistent weighted sampling.

Each of ``samples`` coordinates draws one weighted term: for a term with weight w,
gamma variates r and c and a uniform b that depend on term and coordinate alone give
t = floor(ln w / r + b) and the rank ln c - r (t - b + 1); the lowest rank is drawn,
and (term, t) is the sample.  Two documents draw the same sample with a probability equal to their generalised
Jaccard similarity, sum of least weights over sum of greatest.

Terms are words, ``WORD_WEIGHT`` for each occurrence, and shingles of five words,
one for each: shared passages count most, and very short texts still have terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import textscan as T
from .durable import Workspace

SAMPLES = 64
WIDTH = 5
WORD_WEIGHT = 0.25
CELLS = 1 << 15
U64 = np.uint64
_variates: list[np.ndarray] = []


def variates() -> list[np.ndarray]:
    """r, ln c and b by cell and coordinate.  A term takes each from a cell of its own, told by other bits of its hash."""
    if not _variates:
        rng = np.random.default_rng(2010)
        _variates.extend([rng.gamma(2, 1, (CELLS, SAMPLES)).astype(np.float32), np.log(rng.gamma(2, 1, (CELLS, SAMPLES))).astype(np.float32), rng.random((CELLS, SAMPLES)).astype(np.float32)])
    return _variates


def draw(terms: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16-bit samples (documents x coordinates) of distinct terms with weights; a document without terms draws zeros."""
    r_all, c_all, b_all = variates()
    out = np.zeros((len(starts) - 1, SAMPLES), np.uint16)
    log_w = np.log(weights).astype(np.float32)
    mask = U64(CELLS - 1)
    coordinate = np.arange(SAMPLES, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
    step = 2048
    for d in range(len(starts) - 1):
        best = sample = None
        for at in range(starts[d], starts[d + 1], step):
            some = terms[at : min(at + step, starts[d + 1])]
            r = r_all[(some & mask).astype(np.int64)]
            b = b_all[((some >> U64(15)) & mask).astype(np.int64)]
            t = np.floor(log_w[at : at + len(some), None] / r + b)
            rank = c_all[((some >> U64(30)) & mask).astype(np.int64)] - r * (t - b + 1)
            low = rank.argmin(0)
            cols = np.arange(SAMPLES)
            rank, t = rank[low, cols], t[low, cols].astype(np.int64).view(np.uint64)
            drawn = T.mix(some[low] ^ T.mix(t + coordinate))
            if best is None:
                best, sample = rank, drawn
            else:
                less = rank < best
                best, sample = np.where(less, rank, best), np.where(less, drawn, sample)
        if sample is not None:
            out[d] = np.maximum((sample >> U64(48)).astype(np.uint16), 1)
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Samples of whole texts, null as empty."""
    out = [np.zeros((0, SAMPLES), np.uint16)]
    for run in T.runs(texts, 1 << 18):
        hashes, first = T.words(run)
        long, start = T.shingles(hashes, first, WIDTH)
        of = np.concatenate([np.repeat(np.arange(run.size), np.diff(first)), np.repeat(np.arange(run.size), np.diff(start))])
        terms = np.concatenate([hashes, T.mix(long + U64(77))])
        weight = np.concatenate([np.full(len(hashes), WORD_WEIGHT), np.ones(len(long))])
        order = np.lexsort((terms, of))
        terms, of, weight = terms[order], of[order], weight[order]
        heads = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (of[1:] != of[:-1])])) if len(terms) else np.zeros(0, np.int64)
        sums = np.add.reduceat(weight, heads) if len(heads) else np.zeros(0)
        out.append(draw(terms[heads], sums, np.searchsorted(of[heads], np.arange(run.size + 1))))
    return np.concatenate(out)


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Share of equal samples; two texts without terms are alike."""
    return (one == two).mean(1)


def hexed(samples: np.ndarray) -> list[str]:
    return [x.astype(">u2").tobytes().hex() for x in samples]


def edited(text: str, following: str) -> str:
    """The text with its last half's code points replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = [("part", pa.int32()), ("place", pa.int8()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
RESULT_SQL = "part int, place byte, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
AT_ONCE = 500


def compare(ids: list, texts: list[str], part: int) -> pa.RecordBatch:
    """Rows of documents that have their next one in ``texts``."""
    n = len(texts) - 1
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    own, other = fingerprints(pa.array(texts, pa.large_string())), fingerprints(pa.array(changed, pa.large_string()))
    shas = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]
    columns = [[part] * n, [1] * n, ids[:-1], [None] * n, [len(t) for t in texts[:-1]], shas, hexed(own[:-1]), hexed(other), likeness(own[:-1], other), likeness(own[:-1], own[1:])]
    return pa.RecordBatch.from_arrays([pa.array(x, f[1]) for x, f in zip(columns, RESULT, strict=True)], schema=pa.schema(RESULT))


def edge(part: int, place: int, doc_id, text: str) -> pa.RecordBatch:
    """The first (place 0) or last (place 2) document of a partition with its text."""
    row = [part, place, doc_id, text, None, None, None, None, None, None]
    return pa.RecordBatch.from_arrays([pa.array([x], f[1]) for x, f in zip(row, RESULT, strict=True)], schema=pa.schema(RESULT))


def ordered_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    ids, texts, begun = [], [], False
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(at, AT_ONCE)
            ids += some.column(0).to_pylist()
            texts += [t or "" for t in some.column(1).to_pylist()]
            if not begun and ids:
                begun = True
                yield edge(part, 0, ids[0], texts[0])
            if len(texts) > 1:
                yield compare(ids, texts, part)
                ids, texts = ids[-1:], texts[-1:]
    if begun:
        yield edge(part, 2, ids[0], texts[0])


def last_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            yield compare([doc_id, None], [text, following], 0)


def fingerprint_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and how alike these and the next document's are.

    Returns doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  The next document has the next id
    (null first, equal ids by text hash); the last one's is the first.  A null text
    counts as empty; texts without words have the fingerprint of zeros and are alike
    to each other only.  A single document is its own next.  Repeated rows follow each other.
    Other columns are not read.

    Texts move once, by ranges of ids.  Each range compares its neighbours in order;
    its first and last text are kept beside the results, and the few pairs across
    ranges are compared afterwards.
    """
    space = Workspace(docs.sparkSession, "fingerprints")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    done = space.settle(ordered.mapInArrow(ordered_rows, RESULT_SQL), "ordered")
    firsts = done.filter("place = 0").select(F.col("part").alias("p"), F.col("text").alias("following"))
    parts = done.filter("place = 0").select("part")
    order = Window.orderBy("part")
    pointed = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("p"))
    lasts = done.filter("place = 2").select("part", "doc_id", "text").join(pointed, "part").join(firsts, "p").select("doc_id", "text", "following")
    names = [f[0] for f in RESULT if f[0] not in ("part", "place", "text")]
    return done.filter("place = 1").select(*names).unionByName(lasts.mapInArrow(last_rows, RESULT_SQL).select(*names))
