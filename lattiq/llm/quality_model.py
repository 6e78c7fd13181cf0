"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics.  Every
partition sums its own normal equations; these are added up by coefficient in a
shuffle, and only the finished system, whose size is fixed, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .docstats import NAMES, features
from .durable import Workspace

WAVES = 192
GRID = 2000


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.binary())])
    for batch in batches:
        rows = [x.tobytes() for run in T.runs(batch.column(1)) for x in features(run).astype(np.float32)]
        yield pa.RecordBatch.from_arrays([batch.column(0), T.blobs(rows)], schema=schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), len(NAMES)).astype(np.float64)


class Waves:
    """The random map; ``scale`` is the kernel's width in standard deviations."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, waves: int, scale: float, seed: int):
        rng = np.random.default_rng(seed)
        self.centre, self.spread = centre, spread
        self.turn = rng.normal(0, 1 / scale, (len(centre), waves))
        self.phase = rng.uniform(0, 2 * np.pi, waves)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, np.cos(z @ self.turn + self.phase) * np.sqrt(2 / len(self.phase))], 1)


def moment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, len(NAMES)))
    for batch in batches:
        x = _matrix(batch.column(0))
        total += np.stack([np.full(len(NAMES), len(x)), x.sum(0), (x**2).sum(0)])
    yield pa.RecordBatch.from_arrays([pa.array(range(len(NAMES)), pa.int32()), *(pa.array(t) for t in total)], names=["j", "n", "s", "q"])


def normal_rows(waves: Waves):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                f = np.concatenate([waves(_matrix(some.column(0))), some.column(1).to_numpy(zero_copy_only=False)[:, None]], 1)
                total = f.T @ f if total is None else total + f.T @ f
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    return rows


def score_rows(waves: Waves, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray] | None):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("y", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.concatenate([waves(_matrix(batch.slice(at, 4096).column(1))) @ weights for at in range(0, batch.num_rows, 4096)] or [np.zeros(0)])
            score = raw if knots is None else np.interp(raw, *knots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), batch.column(2)], schema=schema)

    return rows


def isotonic(at: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending bins; (centres, levels) to interpolate between."""
    blocks: list[list[float]] = []
    for x, y, n in zip(at.tolist(), ones.tolist(), counts.tolist(), strict=True):
        blocks.append([x * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", waves: int = WAVES, scale: float = 3.0, ridge: float = 1e-3, threshold: float = 0.3, seed: int = 11) -> DataFrame:
    """Score whole texts by ``label_col``: doc_id, held_out, score (0 to 1), predicted.

    All labelled rows outside the held-out fifth (crc32 of the id's text mod 5 is 0)
    are learned from.  Only statistics of the text enter a score, so equal texts score
    alike; null and empty texts have the statistics of an empty text.  An id with
    several labels counts with their mean; null labels and labels of ids that are not
    there are ignored.  With no label to learn from, or one class only, every score is that class's share
    (0.5 without any).  Null ids are scored and not held out; other columns are not read.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "quality")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stats = space.settle(source.mapInArrow(feature_rows, "doc_id long, x binary"), "stats")
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    learned = space.settle(stats.filter(~held_out(F.col("doc_id"))).join(marks, "doc_id").select("doc_id", "x", "y"), "learned")
    empty = F.lit(None).cast("double").alias("y")
    moments = learned.select("x").mapInArrow(moment_rows, "j int, n double, s double, q double").groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("j").toPandas()
    n = float(moments["n"].max()) if len(moments) else 0.0
    base = learned.agg(F.avg("y")).first()[0]
    if not n or base in (0.0, 1.0):
        scored = stats.select("doc_id", F.lit(0.5 if base is None else float(base)).alias("score"))
    else:
        centre = (moments["s"] / n).to_numpy()
        spread = np.sqrt(np.maximum((moments["q"] / n).to_numpy() - centre**2, 0))
        spread = np.where(spread > 1e-9, spread, 1.0)
        fourier = Waves(centre, spread, waves, scale, seed)
        cells = learned.select("x", "y").mapInArrow(normal_rows(fourier), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        size = int(cells["j"].max()) + 1
        gram = np.zeros((size, size))
        gram[cells["i"], cells["j"]] = gram[cells["j"], cells["i"]] = cells["v"]
        weights = np.linalg.solve(gram[:-1, :-1] / n + ridge * np.eye(size - 1), gram[:-1, -1] / n)
        raw = learned.select("doc_id", "x", "y").mapInArrow(score_rows(fourier, weights, None), "doc_id long, score double, y double")
        cell = F.greatest(F.lit(0), F.least(F.lit(GRID), F.floor((F.col("score") + 0.5) * (GRID / 2))))
        bins = raw.groupBy(cell.alias("cell")).agg(F.sum("score").alias("s"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("cell").toPandas()
        knots = isotonic((bins["s"] / bins["n"]).to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy())
        scored = stats.select("doc_id", "x", empty).mapInArrow(score_rows(fourier, weights, knots), "doc_id long, score double, y double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
