"""Schemes and lossless anchors on small fixtures."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattiq.operators import anchors, schemes


def test_settings_are_read_and_odd_ones_rejected():
    assert schemes.settings("rho=8, uvec=5") == {"rho": 8, "uvec": 5}
    assert schemes.settings("u=8x16x32") == {"u": (8, 16, 32)}
    assert schemes.settings("rho=99.9", float) == {"rho": 99.9}
    for odd in ("rho=8,rho=9", "rho", "=4", "rho="):
        with pytest.raises(ValueError):
            schemes.settings(odd)


def test_schemes_against_a_loop(spark):
    draw = np.random.default_rng(123)
    values = draw.normal(size=(3, 16)).astype("f4")
    values[1, [0, 7]] = -200.0, 900.0
    rows = [("B", 0, k, p, [0.0, 0.2, 1.0][p], float(values[p, k])) for p in range(3) for k in range(16)]
    states = spark.createDataFrame(rows, "field string, block int, cell int, pos long, time double, value double")
    chosen = [schemes.Scheme("tiled", {"B": 7}, {"B": 90.0}, {"B": (2, 2, 2)}), schemes.Scheme("whole", {"B": 4}, {"B": 100.0})]
    told = schemes.encode_schemes(schemes.field_residuals(states, 2), chosen, ("B",), (2, 2, 4))
    got = {(r.scheme, r.cell): (r.code, r.exception) for r in told.collect()}
    line = (np.float32(0.8) * values[0] + np.float32(0.2) * values[2]).astype("f4")
    residual = (values[1] - line).astype("f4")
    tile = np.array([(k % 4) // 2 for k in range(16)])
    for name, top, percent, groups in (("tiled", 63, 90.0, tile), ("whole", 7, 100.0, tile * 0)):
        for g in set(groups):
            of = np.abs(residual[groups == g]).astype("f8")
            scale = np.float32(np.percentile(of, percent) / top)
            for k in np.flatnonzero(groups == g):
                ratio = np.float32(residual[k] / scale)
                exact = float(residual[k]) if percent < 100 and abs(ratio) > top else None
                assert got[(name, k)] == (int(np.clip(np.rint(ratio), -top, top)), exact)
    with pytest.raises(ValueError):
        schemes.encode_schemes(schemes.field_residuals(states, 2), [schemes.Scheme("odd", {"X": 8})], ("B",), (2, 2, 4))


def test_anchors_come_back_bit_for_bit_and_damage_is_found(spark):
    draw = np.random.default_rng(42)
    states = [draw.normal(size=9).astype("f4") for _ in range(7)]
    states[2][:4] = np.inf, -0.0, 1e-42, -np.inf
    rows = [("a", k, [float(x) for x in s]) for k, s in enumerate(states)]
    frame = spark.createDataFrame(rows, "channel string, gop long, values array<float>")
    for kind in ("bzip2", "xz"):
        stored = anchors.packed(frame, 4, kind)
        back = {r.gop: np.array(r["values"], "f4") for r in anchors.unpacked(stored, kind).collect()}
        assert all(back[k].tobytes() == s.tobytes() for k, s in enumerate(states))
    assert [r.order for r in stored.orderBy("gop").collect()] == [0, 1, 2, 2, 0, 1, 2]
    for column in ("crc_payload", "crc_target"):
        with pytest.raises(PySparkException):
            anchors.unpacked(stored.withColumn(column, F.col(column) + 1), kind).collect()
    with pytest.raises(PySparkException):
        anchors.packed(frame.filter("gop <> 1"), 4).collect()
