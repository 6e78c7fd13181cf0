"""Quality rules: counts of each text, and perplexity under a modified Kneser-Ney model of the whole corpus.

Every word and every pair of words of all documents, by language, is in the model,
however rare.  Texts are read once and written as blocks of bounded size: a sorted array of word
hashes and each word's index in it.  What a block needs from the corpus it asks for in
sorted hash arrays, one for each range of hashes, and the answers come back in the same
order, so they carry no keys: first how often each of its pairs occurs in all blocks, then what
all blocks know of each of its words.  Pairs are asked for a range of their hashes at a time and blocks meet their
answers a share at a time, so that shuffle files never hold all of either.  Neither the driver nor
a worker ever holds more than one block or one range.  Hashes have 14 bits more than the
corpus' bytes have, so that few kinds in ten thousand meet by chance, at any size.
A pair that occurs once has no share of its own.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import textscan as T
from .docstats import base
from .durable import Workspace, parts

BLOCK_BYTES = 1 << 24
PASSES, SHARES = 3, 6
STEP = 1e-3
FEW_LANGUAGES, SALTS = 4096, 256
COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BODY, PAIRS, WORDS, SUMS = range(4)
HEAD = struct.Struct("<BQQ")
U64 = np.uint64


def squeeze(*arrays: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, one array after another."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, np.uint64)
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        body = pa.compress(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), codec="zstd", asbytes=True)
        out += [HEAD.pack(width, len(a), len(body)), body]
    return b"".join(out)


def unsqueeze(packed: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(packed):
        width, n, size = HEAD.unpack_from(packed, at)
        at += HEAD.size
        raw = pa.decompress(packed[at : at + size], width * n, codec="zstd", asbytes=True)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
        out.append(wide.view(np.uint64).ravel())
        at += size
    return out


def bins(width: int, many: int) -> np.ndarray:
    """The first hash of each of ``many`` equal ranges of hashes of ``width`` bits."""
    return np.array([(k << width) // many for k in range(many)], np.uint64)


def language_hash(name: str) -> np.uint64:
    return U64(int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


class Body:
    """A block's texts: ``words`` (sorted hashes, beginnings of languages among them), and for each word in a row the indexes of it and of the one before."""

    def __init__(self, packed: bytes, width: int):
        self.width = width
        words, word, before, self.sizes = unsqueeze(packed)
        words = np.cumsum(words, dtype=np.uint64)
        order = np.argsort(words)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.word, self.before = words[order], rank[word.astype(np.int64)], rank[before.astype(np.int64)]
        # A word's predecessor is the word in front of it, but for the first of a text.
        first = np.cumsum(self.sizes).astype(np.int64) - self.sizes.astype(np.int64)
        starts = self.before
        self.before = np.empty(len(self.word), np.int64)
        self.before[1:] = self.word[:-1]
        full = self.sizes > 0
        self.before[first[full]] = starts[full]

    @staticmethod
    def pack(keys: list[np.ndarray], starts: list[np.ndarray], sizes: list[np.ndarray]) -> bytes:
        keys, starts, sizes = (np.concatenate(x) for x in (keys, starts, sizes))
        codes, distinct = pd.factorize(np.concatenate([keys, starts]))
        # Frequent words have small indexes, and words about as frequent stand in order of their hashes: both pack well.
        order = np.lexsort((distinct, -np.frexp(np.bincount(codes).astype(np.float64))[1]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        line = distinct[order].astype(np.uint64)
        index = rank[codes]
        return squeeze(np.diff(line, prepend=U64(0)), index[: len(keys)], index[len(keys) :], sizes)

    def pairs(self, **more) -> tuple[np.ndarray, ...]:
        """Sorted distinct pair hashes, as ``np.unique`` gives them."""
        return np.unique(T.mix(self.words[self.before] * U64(0x9E3779B97F4A7C15) + self.words[self.word]) >> U64(64 - self.width), **more)


def body_rows(width: int, block_bytes: int):
    """Blocks of a partition's documents: their counts (``meta``) and their words."""
    meta = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((x, pa.int64()) for x in COUNTED)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, weight = TaskContext.get().partitionId(), 0, 0
        tables, keys, starts, sizes = [], [], [], []
        known: dict[str, np.uint64] = {}

        def block() -> pa.RecordBatch:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, meta, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for t in tables:
                    out.write_batch(t)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([sink.getvalue()], pa.binary()), pa.array([Body.pack(keys, starts, sizes)], pa.binary())], names=["block", "meta", "payload"])

        for batch in batches:
            names = batch.column(2).to_pylist()
            for n in set(names):
                known.setdefault(n, language_hash(n))
            of_language = np.array([known[n] for n in names], np.uint64)
            for run in T.runs(batch.column(1)):
                counts, hashes, first = base(run)
                own = of_language[run.first : run.first + run.size]
                words = np.diff(first)
                keys.append(T.mix(hashes + np.repeat(own, words) * U64(0x9E3779B97F4A7C15)) >> U64(64 - width))
                starts.append(T.mix(own * U64(0xC2B2AE3D27D4EB4F) + U64(1)) >> U64(64 - width))
                sizes.append(words)
                tables.append(pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.size), batch.column(2).slice(run.first, run.size), *(pa.array(counts[x].astype(np.int64)) for x in COUNTED)], schema=meta))
                weight += len(run.data)
                if weight >= block_bytes:
                    yield block()
                    seq, weight = seq + 1, 0
                    tables, keys, starts, sizes = [], [], [], []
        if tables:
            yield block()

    return T.lean(rows)


ASKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
ASKED_SQL = "part int, block long, payload binary"
ANSWERED = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("payload", pa.binary()), ("sums", pa.list_(pa.int64()))])
ANSWERED_SQL = "kind int, block long, part int, payload binary, sums array<long>"


def asked(block: int, hashes: np.ndarray, columns: list[np.ndarray], first: np.ndarray, low: int = 0) -> pa.RecordBatch:
    """A block's sorted hashes with their columns, one row for each range that has some; ``low`` numbers the first."""
    at = np.append(np.searchsorted(hashes, first), len(hashes)).tolist()
    out = [(low + k, block, squeeze(np.diff(hashes[a:b], prepend=first[k]), *(c[a:b] for c in columns))) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else ((), (), ()), ASKED, strict=True)], schema=ASKED)


def pair_rows(width: int, passes: int, ways: int, step: int):
    """How often each pair of each block occurs there; those whose hash is in the ``step``-th of ``passes`` ranges."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = bins(width, passes * ways)[step * ways : step * ways + ways]
        end = bins(width, passes * ways)[step * ways + ways] if step + 1 < passes else None
        for batch in batches:
            for block, packed in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                hashes, n = Body(packed, width).pairs(return_counts=True)
                low, high = np.searchsorted(hashes, first[0]), len(hashes) if end is None else np.searchsorted(hashes, end)
                yield asked(block, hashes[low:high], [n[low:high]], first, step * ways)

    return T.lean(rows)


def answered_rows(width: int, many: int, solve):
    """Answers to all that is asked of one range of hashes at a time; rows arrive ordered by range and block."""

    def answer(part: int, blocks: list[int], packed: list[bytes]) -> pa.RecordBatch:
        first = bins(width, many)[part]
        told = [unsqueeze(x) for x in packed]
        hashes = np.concatenate([np.cumsum(x[0], dtype=np.uint64) + first for x in told])
        columns = [np.concatenate([x[k] for x in told]).astype(np.int64) for k in range(1, len(told[0]))]
        kind, replies, sums = solve(hashes, columns)
        ends = np.cumsum([len(x[0]) for x in told]).tolist()
        out = [(kind, b, part, squeeze(*(r[low:high] for r in replies)), None) for b, low, high in zip(blocks, [0, *ends], ends, strict=False)]
        out.append((SUMS, 0, part, None, sums))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), ANSWERED, strict=True)], schema=ANSWERED)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, packed = None, [], []
        for batch in batches:
            for own, block, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if own != part and blocks:
                    yield answer(part, blocks, packed)
                    blocks, packed = [], []
                part = own
                blocks.append(block)
                packed.append(payload)
        if blocks:
            yield answer(part, blocks, packed)

    return T.lean(rows)


def pair_totals(hashes: np.ndarray, columns: list[np.ndarray]):
    """Each pair's count in all blocks, doubled, and one more for the first block that holds it; counts of counts 1 to 4."""
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.bincount(back, columns[0]).astype(np.int64)
    code = 2 * total[back]
    code[first] += 1
    return PAIRS, [code], [int((total == k).sum()) for k in (1, 2, 3, 4)]


def word_totals(hashes: np.ndarray, columns: list[np.ndarray]):
    """Of each word: as a first word its count, the count of its pairs of two and more, how many of those occur twice and more often; how many words stand before it."""
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    ahead, behind, often, twice, more, spared = (np.bincount(back, c).astype(np.int64) for c in columns)
    before = behind - spared
    own = before[before > 0]
    return WORDS, [x[back] for x in (ahead, often, twice, more, before)], [int(own.sum()), len(own), *(int((own == k).sum()) for k in (1, 2, 3, 4))]


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, bytes, dict[int, list[bytes]]]]:
    """(block, meta, body, answers by kind) of rows that arrive ordered by block, kind and range."""
    held = None
    for batch in batches:
        for block, kind, meta, payload in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if held is None or held[0] != block:
                if held is not None:
                    yield held
                if kind != BODY:
                    raise RuntimeError("answers without their block")
                held = (block, meta, payload, {PAIRS: [], WORDS: []})
            else:
                held[3][kind].append(payload)
    if held is not None:
        yield held


def told_of(body: Body, packed: list[bytes], pairs: np.ndarray) -> np.ndarray:
    codes = np.concatenate([np.zeros(0, np.uint64), *(unsqueeze(x)[0] for x in packed)]).astype(np.int64)
    if len(codes) != len(pairs):
        raise RuntimeError("a block was not told of all of its pairs")
    return codes


def word_rows(width: int, ways: int):
    """What each block knows of its words; a pair of two and more counts in the first block that holds it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, packed, told in by_block(batches):
            body = Body(packed, width)
            pairs, at = body.pairs(return_index=True)
            codes = told_of(body, told[PAIRS], pairs)
            own = np.flatnonzero((codes & 1 == 1) & (codes > 3))
            total, a, b = codes[own] >> 1, body.before[at[own]], body.word[at[own]]
            count = lambda of, w=None: np.bincount(of, w, minlength=len(body.words)).astype(np.int64)
            columns = [count(body.before), count(body.word), count(a, total), count(a, total == 2), count(a, total > 2), count(b, total - 1)]
            yield asked(block, body.words, columns, bins(width, ways))

    return T.lean(rows)


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2, 3 or more, from how many entries occur 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    out = np.array([0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5])
    return np.clip(out, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.8])


def score_rows(width: int, d: np.ndarray, d1: np.ndarray, kinds: float, even: float):
    """Counts and perplexity of each document of a block."""
    names = ["doc_id", "lang", *COUNTED]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, meta, packed, told in by_block(batches):
            body = Body(packed, width)
            pairs, at, back = body.pairs(return_index=True, return_inverse=True)
            total = told_of(body, told[PAIRS], pairs) >> 1
            columns = list(zip(*(unsqueeze(x) for x in told[WORDS]), strict=True))
            ahead, often, twice, more, before = (np.concatenate(c).astype(np.float64) for c in columns) if columns else (np.zeros(0),) * 5
            if len(ahead) != len(body.words):
                raise RuntimeError("a block was not told of all of its words")
            left = np.where(ahead > 0, 1 - (often - twice * d[2] - more * d[3]) / np.maximum(ahead, 1), 1.0)
            cut = np.minimum(before, d1[np.minimum(before, 3).astype(np.int64)])
            lower = (before - cut) / kinds + even
            a, b = body.before[at], body.word[at]
            p = left[a] * lower[b] + np.where(total > 1, total - d[np.minimum(total, 3)], 0) / ahead[a]
            sizes = body.sizes.astype(np.int64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.bincount(of, np.log(np.maximum(p, 1e-30))[back], minlength=len(sizes))
            value = np.where(sizes > 0, -sums / np.maximum(sizes, 1), np.nan)
            docs = pa.ipc.open_stream(meta).read_all().combine_chunks()
            yield from pa.table([*(docs[n] for n in names), pa.array(value, from_pandas=True)], names=[*names, "log_perplexity"]).to_batches()

    return T.lean(rows)


def quantiles(values: DataFrame, ranked: tuple[float, ...]) -> DataFrame:
    """l, texts, q: of each language's values, how many there are and the least that each share of them does not exceed.

    Ranks are counted over all values, each taken down to its step of ``STEP``, so a language is a few ten thousand
    rows at most when they are put in order, and the result does not hang on how rows are dealt.
    """
    steps = values.groupBy("lang", F.floor(F.col("log_perplexity") / STEP).cast("long").alias("at")).agg(F.count("*").alias("n"))
    line = Window.partitionBy("lang")
    below = steps.withColumn("upto", F.sum("n").over(line.orderBy("at"))).withColumn("texts", F.sum("n").over(line))
    reached = [F.min(F.when(F.col("upto") >= F.col("texts") * share, F.col("at"))) * STEP for share in ranked]
    return below.groupBy(F.col("lang").alias("l")).agg(F.first("texts").alias("texts"), F.array(*reached).alias("q"))


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", word_share: float = 0.0, pair_share: float = 0.0, fence: float = 2.0, least_spread: float = 0.5, tail: float = 0.005, least_texts: int = 50, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Counts of each text, base_failed, kept, log_perplexity and the band it is held against.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, log_perplexity, band_low, band_high.  A language's band, over the
    distinct texts that the base rules pass, reaches ``fence`` times the distance of its quartiles
    (``least_spread`` at least) above the upper one, and down to its quantile ``tail``: clean texts
    with near copies are easily foreseen and make a long lower flank, where quartiles would
    reject a quarter of them.  What lies outside is rejected.  Every language has words, pairs and a band of its
    own, the null language too; one with fewer than ``least_texts`` such texts, too few for quantiles, takes the band of all
    languages together.  Null and blank texts have zero counts, no perplexity, and fail for want of words.
    A very long text is a block of its own, and an empty table gives no rows.  Repeated ids and rows are
    judged each, ids may be null, and other columns are not read.  Every word and pair is in the
    model, so ``word_share`` and ``pair_share`` can only be 0.
    """
    if word_share or pair_share:
        raise ValueError("the model holds every word and pair")
    spark = docs.sparkSession
    space = Workspace(spark, "rules")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    size, languages = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.countDistinct("lang")).first()
    width = min(62, max(40, int(size).bit_length() + 14))
    ways = max(parts(spark), -(-size // (PASSES * BLOCK_BYTES)))
    bodies = space.settle(source.mapInArrow(body_rows(width, BLOCK_BYTES), "block long, meta binary, payload binary"), "bodies")

    def answers(messages: DataFrame, many: int, solve, name: str) -> DataFrame:
        dealt = messages.repartitionById(ways, F.pmod("part", F.lit(ways)).cast("int")).sortWithinPartitions("part", "block")
        return space.settle(dealt.mapInArrow(answered_rows(width, many, solve), ANSWERED_SQL), name)

    def totals(told: DataFrame, n: int) -> list[int]:
        return list(told.filter(F.col("kind") == SUMS).agg(*(F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(n))).first())

    together = lambda frames: reduce(DataFrame.unionByName, frames)
    pairs = together([answers(bodies.select("block", "payload").mapInArrow(pair_rows(width, PASSES, ways, k), ASKED_SQL), PASSES * ways, pair_totals, f"pairs-{k}") for k in range(PASSES)])
    d = discounts(np.array(totals(pairs, 4)))

    def met(share: int, *told: DataFrame) -> DataFrame:
        """Blocks of one share with their answers."""
        rows = bodies.select("block", F.lit(BODY).alias("kind"), "meta", "payload", F.lit(-1).alias("part"))
        for more in told:
            rows = rows.unionByName(more.filter(F.col("kind") != SUMS).select("block", "kind", F.lit(None).cast("binary").alias("meta"), "payload", "part"))
        rows = rows.filter(F.pmod(F.xxhash64("block"), F.lit(SHARES)) == share)
        return rows.repartition(max(parts(spark), -(-size // (SHARES * BLOCK_BYTES))), "block").sortWithinPartitions("block", "kind", "part").select("block", "kind", "meta", "payload")

    asks = together([space.settle(met(k, pairs).mapInArrow(word_rows(width, ways), ASKED_SQL), f"asks-{k}") for k in range(SHARES)])
    words = together([answers(asks.filter(F.pmod("part", F.lit(PASSES)) == k), ways, word_totals, f"words-{k}") for k in range(PASSES)])
    space.drop(*(f"asks-{k}" for k in range(SHARES)))
    kinds, seen, *often = totals(words, 6)
    d1 = discounts(np.array(often))
    spared = often[0] * d1[1] + often[1] * d1[2] + (seen - often[0] - often[1]) * d1[3]
    kinds, known = float(max(kinds, 1)), seen + 2 * (languages + 1)
    fields = "doc_id long, lang string, " + ", ".join(f"{x} long" for x in COUNTED) + ", log_perplexity double"
    scored = together([space.settle(met(k, pairs, words).mapInArrow(score_rows(width, d, d1, kinds, spared / kinds / known), fields), f"scored-{k}") for k in range(SHARES)])
    space.drop("bodies", *(f"{x}-{k}" for x in ("words", "pairs") for k in range(PASSES)))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    scored = scored.withColumn("base_failed", failed)
    # Copies of a text have its perplexity to the last bit.
    distinct_texts = scored.filter(~F.col("base_failed")).select("lang", "log_perplexity").distinct()
    ranked = (0.25, 0.75, tail)
    quarter = quantiles(distinct_texts, ranked)
    common = quantiles(distinct_texts.withColumn("lang", F.lit("")), ranked).select("q").first()
    of_all = F.lit(None).cast("array<double>") if common is None else F.array(*(F.lit(float(x)) for x in common[0]))
    quarter = quarter.withColumn("q", F.when(F.col("texts") >= least_texts, F.col("q")).otherwise(of_all))
    wide = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(least_spread)) * fence
    bands = quarter.select("l", F.col("q")[2].alias("band_low"), (F.col("q")[1] + wide).alias("band_high"))
    if languages <= FEW_LANGUAGES:
        told = scored.join(F.broadcast(bands), F.col("lang") == F.col("l"), "left")
    else:
        # One language may hold most rows: its band goes to many tasks.
        salted = bands.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id", "log_perplexity", "word_chars"), F.lit(SALTS)).cast("int")
        told = scored.join(salted, (F.col("lang") == F.col("l")) & (salt == F.col("s")), "left")
    verdict = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(False))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), "log_perplexity", "band_low", "band_high")
