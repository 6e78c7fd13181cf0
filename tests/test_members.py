"""Archive members: exact round trips, partial reads, damage."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattiq.sources import members

SCHEMA = "channel string, pos long, codes array<int>"


def _rows(wide):
    draw = np.random.default_rng(42)
    top = 32767 if wide else 127
    rows = []
    for channel in ("a", "b"):
        base, rise = draw.integers(-50, 50, 64), draw.integers(-3, 3, 64)
        for p in range(1, 13):
            states = np.clip(base + p * rise + p * p * (40 if wide else 1), -top, top) if channel == "a" else draw.integers(-top, top + 1, 64)
            rows.append((channel, p, [int(x) for x in states]))
    return rows


@pytest.mark.parametrize("wide", [False, True])
def test_members_come_back(spark, wide):
    rows = _rows(wide)
    packed = members.packed(spark.createDataFrame(rows, SCHEMA), 5).cache()
    want = sorted((c, p, tuple(s)) for c, p, s in rows)
    read = lambda frame, kind: sorted((r.channel, r.pos, tuple(r.codes)) for r in members.unpacked(frame, kind).collect())
    assert read(packed, "bzip2") == want
    assert read(members.repacked(packed, 4, "xz"), "xz") == want
    assert read(members.transcoded(packed), "deflate") == want
    assert {tuple(r) for r in packed.select("channel", "chunk", F.size("positions")).collect()} == {(c, k, n) for c in "ab" for k, n in ((0, 5), (1, 5), (2, 2))}


def test_the_shorter_order_is_kept(spark):
    rows = [("a", p, [v * p + a * p * p for v, a in zip(range(-8, 8), [1, -1] * 8)]) for p in range(1, 11)]
    found = members.packed(spark.createDataFrame(rows, SCHEMA), 10).collect()
    assert [r.order for r in found] == [2]
    still = members.packed(spark.createDataFrame([("a", p, [3] * 9) for p in range(1, 3)], SCHEMA), 10).collect()
    assert [r.order for r in still] == [1]


def test_partial_read_and_damage(spark, tmp_path):
    rows = _rows(False)
    packed = members.packed(spark.createDataFrame(rows, SCHEMA), 5)
    members.write_members(packed, str(tmp_path / "m"))
    got = members.read_frames(spark, str(tmp_path / "m"), [2, 11], 5, channels=["b"]).collect()
    assert sorted((r.channel, r.pos, tuple(r.codes)) for r in got) == sorted((c, p, tuple(s)) for c, p, s in rows if c == "b" and p in (2, 11))
    bad = spark.read.parquet(str(tmp_path / "m")).withColumn("crc32", F.when(F.col("chunk") == 1, F.col("crc32") + 1).otherwise(F.col("crc32")))
    assert {tuple(r) for r in members.damaged(bad).collect()} == {("a", 1), ("b", 1)}
    with pytest.raises(PySparkException):
        members.unpacked(bad).collect()
    assert members.unpacked(spark.createDataFrame([], packed.schema)).collect() == []
