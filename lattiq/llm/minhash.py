"""MinHash near-duplicates by an inverted join over signature coordinates.

Texts are collapsed to classes of equal shingle sets.  Each class posts itself
under its (coordinate, value) pairs, whose values have 64 bits, so that lists meet by
what texts share and not by chance.  Two classes with at least ``matches`` equal
coordinates must share one of the rarest postings of either side: of a class's shared
postings all but ``matches - 1``, in one global order, are its prefix.  Only prefix lists are
merged, the frequent rest is skipped, and of lists with the same members one is kept.

Nothing is ever expanded into rows of pairs.  A list is one block (or several, if it is
long), in which classes are compared on signatures of 256 coordinates of a byte; a block
gives no more links than join what it holds.  Candidates so linked are groups, and a group is
compared in the same way once more, now confirmed on full shingle sets.  A group of more
than one block goes through two rounds: every block with the group's most central class first,
then pairs of blocks that still hold different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as T
from .components import components
from .durable import Workspace

_rng = np.random.default_rng(7)
COORDINATES = 64
FINE = 256
BLOCK_BYTES = 1 << 23
BLOCK_ROWS = 4096
SMALL = 8
_SCALE = _rng.integers(1, 2**63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 2**63, FINE, dtype=np.uint64)


def _distinct(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the run's first document, shingle hashes, starts, sorted distinct counts) of each run."""
    for run in T.runs(column):
        hashes, start = T.shingles(*T.words(run, fold=True), width)
        yield run.first, hashes, start, run.size


def _set_of(hashes: np.ndarray) -> np.ndarray:
    own = np.sort(hashes)
    return own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def _set_ids(own: np.ndarray) -> tuple[int, int]:
    one = int(T.mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64))
    two = int(T.mix(own + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64))
    return one - (one >> 63 << 64), two - (two >> 63 << 64)


def signatures(hashes: np.ndarray, heads: np.ndarray, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit minima of ``coordinates`` permutations, one byte of each of ``FINE`` minima) of the sets that begin at ``heads``."""
    coarse = np.empty((len(heads), coordinates), np.uint64)
    fine = np.empty((len(heads), FINE), np.uint8)
    for k in range(coordinates):
        coarse[:, k] = np.minimum.reduceat(hashes * _SCALE[k] + _SHIFT[k], heads)
        fine[:, k] = (T.mix(coarse[:, k]) >> np.uint64(56)).astype(np.uint8)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(coordinates, FINE):
        low = np.minimum.reduceat(short * np.uint32(_SCALE[k] & np.uint64(0xFFFFFFFF)) + np.uint32(_SHIFT[k] & np.uint64(0xFFFFFFFF)), heads)
        fine[:, k] = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    return coarse, fine


def signature_rows(width: int, coordinates: int, key: pa.DataType):
    schema = pa.schema([("doc_id", key), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.list_(pa.int64())), ("fine", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, sig, fine = [], [], [], [], []
            for _, hashes, start, size in _distinct(batch.column(1), width):
                full = np.flatnonzero(np.diff(start))
                if len(full):
                    coarse, bytes_ = signatures(hashes, start[:-1][full], coordinates)
                at = 0
                for d in range(size):
                    own = _set_of(hashes[start[d] : start[d + 1]])
                    one, two = _set_ids(own)
                    n.append(len(own))
                    s1.append(one)
                    s2.append(two)
                    if len(own):
                        sig.append(coarse[at].view(np.int64))
                        fine.append(bytes_[at].tobytes())
                        at += 1
                    else:
                        sig.append(None)
                        fine.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.list_(pa.int64())), T.blobs(fine)], schema=schema)

    return T.lean(rows)


def set_rows(width: int):
    """Full sets of the classes asked for; a text that no longer matches its class is left out."""
    schema = pa.schema([("node", pa.int64()), ("own", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, own = [], []
            ids, s1, s2 = (batch.column(k).to_pylist() for k in (0, 1, 2))
            for first, hashes, start, size in _distinct(batch.column(3), width):
                for d in range(size):
                    mine = _set_of(hashes[start[d] : start[d + 1]])
                    if _set_ids(mine) == (s1[first + d], s2[first + d]):
                        node.append(ids[first + d])
                        own.append(mine.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), T.blobs(own)], schema=schema)

    return T.lean(rows)


def agreeing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many of their bytes the rows of two byte tables agree."""
    return np.bitwise_count(np.packbits(one == two, axis=1).view(np.uint64)).sum(1, dtype=np.int64)


def fixed_rows(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """A binary column of ``size`` bytes a row as a table of bytes."""
    parts = [np.frombuffer(c.buffers()[2], np.uint8)[(at := np.frombuffer(c.buffers()[1], np.int32)[c.offset :])[0] : at[len(c)]] for c in column.chunks if len(c)]
    return np.concatenate(parts).reshape(-1, size)


class Block:
    """Classes that are compared with each other; links between those of different components, as few as join them."""

    def __init__(self, table: pa.Table, least: int, percent: int | None):
        self.node, comp, self.n = (table[c].to_numpy() for c in ("node", "comp", "n"))
        self.fine = fixed_rows(table["fine"], FINE)
        self.least, self.percent = least, percent
        self.sets = None if percent is None else [np.frombuffer(x.as_buffer(), np.uint64) for c in table["own"].chunks for x in c]
        self.comp = comp
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def linked(self, r: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` share enough of their sets with ``r``."""
        mine, sizes = self.sets[r], np.array([len(self.sets[o]) for o in others])
        if not len(sizes):
            return np.zeros(0, bool)
        every = np.concatenate([self.sets[o] for o in others])
        at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
        shared = np.add.reduceat((mine[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        return 100 * shared >= self.percent * (sizes + len(mine) - shared)

    def small(self, group: np.ndarray, few: np.ndarray) -> None:
        """All pairs inside groups of at most ``SMALL``, many groups at a time."""
        for d in range(1, SMALL):
            at = np.flatnonzero((group[:-d] == group[d:]) & few[:-d]) if len(group) > d else np.zeros(0, np.int64)
            at = at[self.comp[at] != self.comp[at + d]]
            if self.percent is not None:
                at = at[100 * np.minimum(self.n[at], self.n[at + d]) >= self.percent * np.maximum(self.n[at], self.n[at + d])]
            for low in range(0, len(at), 1 << 15):
                a = at[low : low + (1 << 15)]
                a = a[agreeing(self.fine[a], self.fine[a + d]) >= self.least]
                if self.percent is not None:
                    a = a[np.array([self.linked(x, np.array([x + d]))[0] for x in a.tolist()], bool)]
                self.found.append((self.node[a], self.node[a + d]))

    def large(self, rows: np.ndarray) -> None:
        """One group: everyone not yet in the component of the first is compared with all others of other components."""
        fine, n = self.fine[rows], self.n[rows]
        place = np.unique(self.comp[rows], return_inverse=True)[1]
        some = rows[:: max(1, len(rows) // 16)]
        first = int(np.argmax(sum(agreeing(fine, self.fine[s][None]) for s in some)))
        a, b = [], []
        for r in [first, *range(len(rows))]:
            if a and place[r] == place[first]:
                continue
            others = np.flatnonzero(place != place[r])
            if self.percent is not None:
                others = others[100 * np.minimum(n[others], n[r]) >= self.percent * np.maximum(n[others], n[r])]
            agree = agreeing(fine[others], fine[r][None])
            others = others[agree >= self.least]
            if self.percent is not None:
                others = others[np.argsort(-agree[agree >= self.least], kind="stable")]
            while len(others):
                some, others = others[:64], others[64:]
                if self.percent is not None:
                    some = some[self.linked(rows[r], rows[some])]
                for o in some.tolist():
                    if place[o] != place[r]:
                        a.append(rows[r])
                        b.append(rows[o])
                        place[place == place[o]] = place[r]
                others = others[place[others] != place[r]]
        self.found.append((self.node[np.array(a, np.int64)], self.node[np.array(b, np.int64)]))


def block_rows(least: int, percent: int | None):
    """Links of each block; rows arrive ordered by block."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(table: pa.Table) -> pa.RecordBatch:
        block, part = table["block"].to_numpy(), table["part"].to_numpy()
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (part[1:] != part[:-1])])
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        own = Block(table, least, percent)
        own.small(group, sizes[group] <= SMALL)
        ends = np.cumsum(sizes)
        for g in np.flatnonzero(sizes > SMALL).tolist():
            own.large(np.arange(ends[g] - sizes[g], ends[g]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in own.found)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            block, part = held["block"].to_numpy(), held["part"].to_numpy()
            new = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1]))
            if len(new):
                yield solve(held.slice(0, new[-1] + 1))
                held = held.slice(new[-1] + 1)
        if held is not None:
            yield solve(held)

    return T.lean(rows)


def linked_in_blocks(members: DataFrame, payload: DataFrame, central: DataFrame, weight: Column, space: Workspace, name: str, least: int, percent: int | None) -> DataFrame:
    """Links (a, b) that join whatever is alike within the groups of ``members`` (block, node).

    ``payload`` has for each node n, fine and, if ``percent`` is given, own; ``weight`` is a row's bytes.  A group of more than about
    ``BLOCK_ROWS`` rows or ``BLOCK_BYTES`` bytes is cut into parts, each with the group's
    most central class; pairs of parts follow where components are still apart, except of parts that are
    of one component as a whole.  Rows that go around are then a part's, once for each
    part it meets; a group whose classes are all linked never meets again.
    """
    columns = ["block", "part", "node", "comp", "n", "fine"] + ["own"] * (percent is not None)
    ways = F.ceil(F.greatest(F.sum("weight") / BLOCK_BYTES, F.count("*") / BLOCK_ROWS)).cast("int")

    def solved(rows: DataFrame, step: str) -> DataFrame:
        asked = rows.select(columns).repartition("block", "part").sortWithinPartitions("block", "part", "node")
        return space.settle(asked.mapInArrow(block_rows(least, percent), "a long, b long"), f"{name}-{step}")

    weighed = members.join(payload.select("node", weight.alias("weight")), "node").join(central, "node")
    groups = space.settle(weighed.groupBy("block").agg(ways.alias("ways"), F.max(F.struct("central", "node"))["node"].alias("head"), F.sum("weight").alias("weight")), f"{name}-groups")
    long = groups.filter("ways > 1")
    many = not long.isEmpty()
    whole = members.join(groups.select("block", "ways"), "block").select("block", F.pmod(F.xxhash64("node"), F.col("ways")).alias("part"), "node")
    if many:
        heads = long.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways").cast("long") - 1)).alias("part"), F.col("head").alias("node"))
        whole = whole.unionByName(heads).distinct()
    links = solved(whole.join(payload, "node").withColumn("comp", F.col("node")), "first")
    if not many:
        return links
    placed = components(links, space, f"{name}-placed")
    told = members.join(long.select("block"), "block").join(payload.select("node", weight.alias("weight")), "node").join(placed, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    told = space.settle(told, f"{name}-told")
    apart = told.groupBy("block", "comp").agg(ways.alias("ways"), F.count("*").alias("rows"), F.sum("weight").alias("weight"))
    # Components of a block's size have parts of their own; the small ones share theirs.
    rest = apart.filter("ways = 1").groupBy("block").agg(F.ceil(F.greatest(F.sum("weight") / BLOCK_BYTES, F.sum("rows") / BLOCK_ROWS)).cast("int").alias("shared"))
    own = F.when(F.col("ways") > 1, F.xxhash64("comp", F.pmod(F.xxhash64("node"), F.col("ways")))).otherwise(F.pmod(F.xxhash64("comp"), F.coalesce("shared", F.lit(1))).cast("long"))
    spread = told.join(apart.select("block", "comp", "ways"), ["block", "comp"]).join(rest, "block", "left")
    spread = space.settle(spread.select("block", "node", "comp", own.alias("own_part"), F.when(F.col("ways") > 1, F.col("comp")).alias("pure")), f"{name}-parts")
    parts = spread.groupBy("block", "own_part").agg(F.max("pure").alias("pure"))
    one, two = (parts.select("block", F.col("own_part").alias(f"p{k}"), F.col("pure").alias(f"pure{k}")) for k in (1, 2))
    met = one.join(two, "block").filter("p1 <= p2 and (pure1 is null or pure2 is null or pure1 <> pure2)")
    met = met.select("block", "p1", "p2", F.xxhash64("p1", "p2").alias("part"))
    sides = met.select("block", "part", F.explode(F.array_distinct(F.array("p1", "p2"))).alias("own_part"))
    rows = spread.select("block", "own_part", "node", "comp").join(sides, ["block", "own_part"]).join(payload, "node")
    return links.unionByName(solved(rows, "second"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, matches: int = 36, coordinates: int = COORDINATES, least: int = 172) -> DataFrame:
    """Link documents whose word-shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer
    than ``width`` words has them all as its one shingle.  Returns one row per
    input row: id, n_shingles, component_id (smallest id reachable, itself
    included), kept (id = component_id).

    Null or blank texts have no shingles and stand alone.  Rows that repeat an id
    are documents of their own.  A null id is larger than any other, so it names a
    component only when all its members are null; kept is then null.  A very long text is
    a large set like any other, and an empty table gives no rows.  Columns other
    than the two named are not read.  At similarity 0.8 a pair agrees in 51 of 64 coordinates on
    average and fewer than 36 has a probability below 1e-5; in 256 it agrees in 205, fewer than
    172 below 1e-6.  Both are less likely above 0.8.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = space.settle(source.mapInArrow(signature_rows(width, coordinates, pa.int64()), "doc_id long, n_shingles long, s1 long, s2 long, sig array<long>, fine binary"), "signed")
    full = signed.filter("n_shingles > 0")
    classes = space.settle(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("fine").alias("fine"), F.first("n_shingles").alias("n")).withColumn("node", F.monotonically_increasing_id()), "classes")
    posted = classes.select("node", F.posexplode("sig").alias("k", "v")).select("node", F.xxhash64("k", "v").alias("key"))
    sizes = space.settle(posted.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    mine = Window.partitionBy("node")
    ranked = posted.join(sizes, "key").withColumn("shared", F.count("*").over(mine)).filter(F.col("shared") >= matches)
    ranked = ranked.withColumn("central", F.sum("size").over(mine)).withColumn("place", F.row_number().over(mine.orderBy("size", "key")))
    prefix = space.settle(ranked.filter(F.col("place") <= F.col("shared") - matches + 1).select("key", "node", "central"), "prefix")
    central = space.settle(prefix.groupBy("node").agg(F.max("central").alias("central")), "central")
    # Lists with the same members say the same; two independent hashes of a set tell them apart.
    lists = prefix.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("n > 1")
    merged = lists.groupBy("n", "x", "y").agg(F.min("key").alias("block"))
    members = space.settle(prefix.join(merged, F.col("key") == F.col("block")).select("block", "node"), "members")
    space.drop("sizes", "prefix")

    signs = classes.select("node", "n", "fine").join(central.select("node"), "node", "left_semi")
    signs = space.settle(signs, "signs")
    alike = linked_in_blocks(members, signs, central, F.lit(FINE), space, "alike", least, None)
    grouped = components(alike, space, "grouped").select(F.col("comp").alias("block"), "node")
    asked = classes.select("node", "s1", "s2", "rep", "n", "fine").join(grouped.select("node"), "node")
    asked = space.settle(asked, "asked")
    found = asked.select("node", "s1", "s2", "rep").join(source, F.col("rep").eqNullSafe(F.col("doc_id"))).select("node", "s1", "s2", "text")
    sets = found.mapInArrow(set_rows(width), "node long, own binary").groupBy("node").agg(F.first("own").alias("own"))
    held = space.settle(asked.select("node", "n", "fine").join(sets, "node"), "held")
    links = linked_in_blocks(grouped, held, central, F.octet_length("own"), space, "links", least, percent)
    placed = components(links, space, "placed")
    smallest = classes.select("node", "rep").join(placed, "node").groupBy("comp").agg(F.min("rep").alias("component"))
    named = classes.select("node", "s1", "s2", "rep").join(placed, "node", "left").join(smallest, "comp", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    named = space.settle(named, "named")
    alone = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = full.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))
