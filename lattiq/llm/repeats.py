"""Removal of repeated passages by suffix sorting of the places where they can lie.

A byte string of ``span`` bytes holds exactly one window of ``span - GRAM + 1``
grams; the smallest gram hash of that window (leftmost of equals) is its anchor,
so equal strings have equal anchors at equal offsets.  Only anchors whose gram
occurs twice or more can lie in a repeat.  Around these the surrounding bytes are
cut out; equal cuts are merged before they meet others, and cuts that share an
anchor are sorted by the suffixes of their content-defined phrases
(:mod:`.lyndon`).  A run of that order whose neighbours have enough phrases in common
is what names a repeat; the bytes before its first and after its last phrase are compared by a
64-bit hash.  Whole texts that stand twice are told by a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .durable import Workspace
from .lyndon import suffix_array

GRAM = 32
GRAIN = 32
EDGE = 4
BLOCK = 1 << 20
HOT = 20_000
WAYS = 8
U64 = np.uint64


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes (a power of two) from each position on."""
    h = T.mix(data.astype(np.uint64) + U64(1))
    step = 1
    while step < width:
        ahead = h[step:]
        h = h[:-step] * U64(0x9E3779B97F4A7C15) + (ahead ^ (ahead >> U64(29)))
        step *= 2
    return T.mix(h)


def anchors(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the anchors of one text of ``span`` bytes or more."""
    found = []
    reach = span - GRAM + 1
    size = 1 << 17
    for begin in range(0, len(data) - span + 1, size):
        h = gram_hashes(data[begin : begin + size + span - 1], GRAM)
        low = (h >> U64(32) << U64(32)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step * 2 <= reach:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if reach > step:
            low = np.minimum(low[: len(low) - reach + step], low[reach - step :])
        at = (low & U64(0xFFFFFFFF)).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        found.append((at + begin, h[at]))
    if len(found) == 1:
        return found[0]
    at, h = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = np.concatenate([[True], at[1:] != at[:-1]])
    return at[keep], h[keep]


def anchor_rows(span: int):
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("pos", pa.int32()), ("gram", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.text_buffers(batch.column(2))
            of, at, grams = [], [], []
            for k in range(batch.num_rows):
                if offsets[k + 1] - offsets[k] >= span:
                    where, h = anchors(data[offsets[k] : offsets[k + 1]], span)
                    of.append(np.full(len(where), k))
                    at.append(where.astype(np.int32))
                    grams.append(T.signed(h))
            if of:
                of = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(np.concatenate(at)), pa.array(np.concatenate(grams))], schema=schema)

    return T.lean(rows)


CUTS = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int32()), ("key", pa.int64()), ("lead", pa.int32()), ("u1", pa.int64()), ("u2", pa.int64()), ("cut", pa.binary())])


def digest(*parts) -> tuple[int, int]:
    name = hashlib.blake2b(b"%d %d " % parts[:2] + parts[2], digest_size=16).digest()
    return int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)


def recorded(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def cut_rows(span: int):
    """The cut around each anchor that may repeat: all strings of ``span`` bytes that hold it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.text_buffers(batch.column(2))
            data = data.tobytes()
            spots = batch.column(3)
            flat, bounds = spots.flatten(), spots.offsets.to_numpy()
            bounds = bounds - bounds[0]
            where, gram = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            t1, t2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for k in range(batch.num_rows):
                begin, end = int(offsets[k]), int(offsets[k + 1])
                for j in range(bounds[k], bounds[k + 1]):
                    p, g = int(where[j]), int(gram[j])
                    low = max(0, p - span + GRAM)
                    own = data[begin + low : min(end, begin + p + span)]
                    out.append((t1[k], t2[k], low, g, p - low, *digest(g, p - low, own), own))
                    if len(out) >= 20_000:
                        yield recorded(out, CUTS)
                        out = []
            if out:
                yield recorded(out, CUTS)

    return T.lean(rows)


SLICES = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("start", pa.int32()), ("twice", pa.bool_()), ("key", pa.int64()), ("lead", pa.int32()), ("u1", pa.int64()), ("u2", pa.int64()), ("cut", pa.binary())])


def slice_rows(span: int, step: int):
    """Shorter cuts of each cut, one for every ``step`` distances from the anchor, keyed by the bytes that their strings have in common."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p1, p2, key, lead, twice, cut in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                for x in range((lead - len(cut) + span) // step * step, lead + 1, step):
                    low, high = max(0, lead - x - step + 1), min(len(cut), lead - x + span)
                    if high - low < span or low > lead - x:
                        continue
                    core = cut[max(0, lead - x) : lead - x - step + 1 + span]
                    own = cut[low:high]
                    name = digest(key, x, core)[0]
                    out.append((p1, p2, low, twice, name, lead - low, *digest(name, lead - low, own), own))
                if len(out) >= 20_000:
                    yield recorded(out, SLICES)
                    out = []
            if out:
                yield recorded(out, SLICES)

    return T.lean(rows)


def phrase_ends(data: np.ndarray, grain: int) -> np.ndarray:
    """Positions after which a phrase ends, by the last ``EDGE`` bytes alone."""
    if len(data) < EDGE:
        return np.zeros(0, np.int64)
    return np.flatnonzero(gram_hashes(data, EDGE) % U64(grain) == 0) + EDGE


def repeated_starts(keys: np.ndarray, leads: np.ndarray, cuts: list[bytes], twice: np.ndarray, span: int, grain: int = GRAIN, order_of=suffix_array) -> list[np.ndarray]:
    """For each cut, the starts whose ``span`` bytes stand at the same place about the anchor in another cut of its key, or in a cut that stands ``twice``.

    The phrases of equal strings are equal, so their suffixes lie in one run of the suffix order whose
    neighbours share that many phrases: the run names the phrases, and with it go the bytes before the
    first and after the last of them.
    """
    sizes = np.array([len(c) for c in cuts], np.int64)
    data = np.frombuffer(b"".join(cuts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    ends = phrase_ends(data, grain)
    row = np.searchsorted(offsets, ends, "left") - 1
    inside = ends - offsets[row] >= EDGE
    ends, row = ends[inside], row[inside]
    # A phrase reaches from one end to the next of the same cut; a mark no other symbol equals follows the last.
    paired = row[:-1] == row[1:]
    symbol = np.empty(len(ends), np.uint64)
    if len(ends):
        symbol[-1] = 0
        symbol[:-1][paired] = T.range_hash(data, ends[:-1][paired], ends[1:][paired])
    last = np.ones(len(ends), bool)
    last[:-1] = ~paired
    ranks = np.empty(len(ends), np.int64)
    marks = int(last.sum())
    ranks[last] = np.arange(marks)
    ranks[~last] = np.unique(symbol[~last], return_inverse=True)[1] + marks
    order = np.array(order_of(ranks.tolist()), np.int64)
    length = np.zeros(max(0, len(order) - 1), np.int64)
    if len(order) > 1:
        one, two = order[:-1], order[1:]
        alive = np.arange(len(one))
        for step in range(span + 1):
            a, b = one[alive] + step, two[alive] + step
            ok = (a < len(ranks)) & (b < len(ranks))
            alive, a, b = alive[ok], a[ok], b[ok]
            alive = alive[ranks[a] == ranks[b]]
            if not alive.size:
                break
            length[alive] += 1
    at_rank = np.empty(len(order), np.int64)
    at_rank[order] = np.arange(len(order))
    # All starts, and the phrases that lie whole in the string from each.
    spots = np.maximum(sizes - span + 1, 0)
    of = np.repeat(np.arange(len(cuts)), spots)
    at = np.arange(len(of)) - np.repeat(np.cumsum(spots) - spots, spots) + offsets[of]
    head = np.searchsorted(ends, at + EDGE, "left")
    tail = np.searchsorted(ends, at + span, "right") - 1
    need = tail - head
    name = np.zeros(len(of), np.uint64)
    open_ = need <= 0
    for v in np.unique(need[~open_]).tolist():
        own = np.flatnonzero(need == v)
        split = np.concatenate([[0], np.cumsum(length < v)])
        run = split[at_rank[head[own]]]
        wide = np.bincount(split)[run] > 1
        own, run = own[wide], run[wide]
        open_[own] = True
        name[own] = T.mix(run.astype(np.uint64) * U64(1024) + U64(v))
    # A start of a cut that stands twice needs no other; the rest must share its run with one.
    open_ |= twice[of]
    of, at, head, tail, need, name = (x[open_] for x in (of, at, head, tail, need, name))
    some = need > 0
    first = np.where(some, ends[np.minimum(head, len(ends) - 1)] if len(ends) else at, at + span)
    final = np.where(some, ends[np.maximum(tail, 0)] if len(ends) else at, at + span)
    edge = T.range_hash(data, at, first) + T.mix(T.range_hash(data, final, at + span) + U64(0x632BE59BD9B4E019))
    place = (leads[of] - (at - offsets[of])).astype(np.uint64)
    value = T.mix(name ^ T.mix(edge ^ T.mix(keys.view(np.uint64)[of] + place * U64(0x9E3779B97F4A7C15))))
    _, back = np.unique(value, return_inverse=True)
    times = np.bincount(back, 1 + twice[of])
    found = times[back] > 1
    of, at = of[found], at[found] - offsets[of[found]]
    return np.split(at, np.searchsorted(of, np.arange(1, len(cuts))))


def stretches(starts: np.ndarray) -> list[int]:
    """Ascending starts as a flat list first, last, first, last ..."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])]], 1).ravel().tolist()


def block_rows(span: int, grain: int):
    """Suffix-sort runs of whole keys; rows arrive ordered by key."""
    schema = pa.schema([("u1", pa.int64()), ("u2", pa.int64()), ("stretch", pa.list_(pa.int32()))])

    def solve(rows):
        keys = np.array([r[0] for r in rows], np.int64)
        leads = np.array([r[1] for r in rows], np.int64)
        twice = np.array([r[5] for r in rows], bool)
        found = [stretches(x) for x in repeated_starts(keys, leads, [r[4] for r in rows], twice, span, grain)]
        kept = [k for k, x in enumerate(found) if x]
        return pa.RecordBatch.from_arrays([pa.array([rows[k][2] for k in kept], pa.int64()), pa.array([rows[k][3] for k in kept], pa.int64()), pa.array([found[k] for k in kept], pa.list_(pa.int32()))], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if weight > BLOCK and row[0] != held[-1][0]:
                    yield solve(held)
                    held, weight = [], 0
                held.append(row)
                weight += len(row[4])
        if held:
            yield solve(held)

    return T.lean(rows)


def cut_out(size: int, pairs: list[int], span: int, start: int = 0) -> list[tuple[int, int]]:
    """Maximal covered ranges of a text from (first, last) pairs of starts."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(zip(pairs[::2], pairs[1::2], strict=True)):
        first, last = first + start, min(size, last + start + span)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def report_rows(span: int, key: pa.DataType, texts: bool):
    schema = pa.schema([("doc_id", key), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_text", pa.string()) if texts else ("kept_sha256", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, many, digest = [], [], [], []
            data, offsets = T.text_buffers(batch.column(1))
            data = data.tobytes()
            blank = batch.column(1).is_null().to_pylist()
            for k, (copies, pairs) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                text = data[offsets[k] : offsets[k + 1]]
                n = len(text)
                ranges = [(0, n)] if copies > 1 and n >= span else cut_out(n, [x for p in pairs or () for x in p], span)
                at, kept = 0, []
                for low, high in ranges:
                    kept.append(text[at:low])
                    at = high
                kept.append(text[at:])
                kept = b"".join(kept)
                size.append(n)
                gone.append(n - len(kept))
                many.append(len(ranges))
                # Cuts may split a character; what is left of it becomes U+FFFD in a text, never in the digest.
                digest.append((None if blank[k] else kept.decode("utf-8", "replace")) if texts else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, many)), pa.array(digest, pa.string())], schema=schema)

    return T.lean(rows)


def repeated_stretches(unlike: DataFrame, space: Workspace, span: int, grain: int, step: int, label: str) -> DataFrame:
    """(u1, u2, stretch) of the distinct cuts (key, lead, u1, u2, cut, twice) that hold repeated starts.

    Cuts of one key are sorted together; a key of more than ``HOT`` distinct cuts is cut into
    slices of ``step`` starts each, whose common bytes are keys of their own, and so on down to single
    starts, where equal cuts are all there is.  A cut has at most ``WAYS`` slices at each of three levels.
    """
    alike = unlike.filter("twice").select("u1", "u2", F.array(F.lit(0), F.octet_length("cut") - span).alias("stretch"))
    keys = unlike.groupBy("key").agg(F.count("*").alias("n"), F.min("twice").alias("all")).filter("n > 1 and not all")
    keys = space.settle(keys.select("key", (F.col("n") > HOT).alias("hot")), f"keys-{label}")
    asked = unlike.join(keys.filter("not hot").select("key"), "key").select("key", "lead", "u1", "u2", "cut", "twice")
    solved = asked.repartition("key").sortWithinPartitions("key", "u1", "u2").mapInArrow(block_rows(span, grain), "u1 long, u2 long, stretch array<int>")
    found = solved.join(alike.select("u1", "u2"), ["u1", "u2"], "left_anti").unionByName(alike)
    if step and not keys.filter("hot").isEmpty():
        wide = unlike.join(keys.filter("hot").select("key"), "key").select("u1", "u2", "key", "lead", "twice", "cut")
        slices = space.settle(wide.mapInArrow(slice_rows(span, step), "p1 long, p2 long, start int, twice boolean, key long, lead int, u1 long, u2 long, cut binary"), f"slices-{label}")
        parent = F.xxhash64("p1", "p2")
        below = slices.groupBy("u1", "u2").agg(F.first("key").alias("key"), F.first("lead").alias("lead"), F.first("cut").alias("cut"), (F.max("twice") | (F.min(parent) != F.max(parent))).alias("twice"))
        below = space.settle(below, f"below-{label}")
        lower = repeated_stretches(below, space, span, grain, 0 if step == 1 else -(-step // WAYS), f"{label}-{step}")
        whole = slices.filter("not twice").select("p1", "p2", "start", "u1", "u2").join(lower, ["u1", "u2"])
        found = found.unionByName(whole.select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.transform("stretch", lambda x: x + F.col("start")).alias("stretch")))
    return found


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 200, grain: int = GRAIN, texts: bool = False) -> DataFrame:
    """Drop every byte covered by a ``span``-byte string that also starts anywhere else.

    Texts are judged as UTF-8 bytes on the input as it is, same document included;
    matches never cross documents.  Returns doc_id, n_bytes, n_removed, n_spans and
    kept_sha256, or with ``texts`` kept_text in its place.

    A null text counts as empty (its kept_text stays null) and shorter texts than
    ``span`` never change.  Rows with equal texts are copies of each other, whatever
    their ids, so repeated rows lose everything.  Ids are only carried along: they
    may be null or repeat.  Other columns are not read.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "repeats")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("h", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).select("doc_id", "text", *(F.conv(F.substring("h", a, 15), 16, 10).cast("long").alias(t) for t, a in (("t1", 1), ("t2", 16))))
    long = source.filter(F.octet_length("text") >= span)
    copies = space.settle(long.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "copies")
    found = space.settle(long.select("t1", "t2", "text").mapInArrow(anchor_rows(span), "t1 long, t2 long, pos int, gram long"), "anchors")
    occurrence = F.xxhash64("t1", "t2", "pos")
    grams = found.withColumn("o", occurrence).groupBy("gram").agg(F.min("o").alias("low"), F.max("o").alias("high")).filter("low <> high").select("gram")
    grams = space.settle(grams, "grams")
    spots = found.join(grams, "gram").groupBy("t1", "t2").agg(F.collect_set(F.struct("pos", "gram")).alias("spots"))
    spots = space.settle(spots, "spots")
    space.drop("anchors", "grams")
    named = spots.join(copies, ["t1", "t2"]).select(F.col("t1").alias("w1"), F.col("t2").alias("w2"), "rep", "spots")
    held = long.join(named, (F.col("doc_id").eqNullSafe(F.col("rep"))) & (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")))
    cuts = space.settle(held.select("t1", "t2", "text", "spots").mapInArrow(cut_rows(span), "t1 long, t2 long, start int, key long, lead int, u1 long, u2 long, cut binary"), "cuts")
    space.drop("spots")
    place = F.xxhash64("t1", "t2", "start", "lead")
    unlike = cuts.withColumn("o", place).groupBy("u1", "u2").agg(F.first("key").alias("key"), F.first("lead").alias("lead"), F.first("cut").alias("cut"), (F.min("o") != F.max("o")).alias("twice"))
    unlike = space.settle(unlike, "unlike")
    stretch = repeated_stretches(unlike, space, span, grain, -(-(span - GRAM + 1) // WAYS), "0")
    covers = cuts.select("t1", "t2", "start", "u1", "u2").distinct().join(stretch, ["u1", "u2"]).groupBy("t1", "t2").agg(F.collect_list(F.transform("stretch", lambda x: x + F.col("start"))).alias("pairs"))
    covers = space.settle(covers, "covers")
    space.drop("cuts", "unlike")
    told = copies.select("t1", "t2", "copies").join(covers, ["t1", "t2"], "left").filter("copies > 1 or pairs is not null")
    full = source.join(told, ["t1", "t2"], "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "pairs")
    out = "kept_text string" if texts else "kept_sha256 string"
    return full.mapInArrow(report_rows(span, pa.int64(), texts), f"doc_id long, n_bytes long, n_removed long, n_spans long, {out}")
