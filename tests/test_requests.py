"""Requests, chunk rules and settings on small fixtures."""

import pytest
from pyspark.errors import PySparkException

import lattiq
from lattiq.operators import difference, requests
from lattiq.streaming import encoder


def test_a_batch_over_its_limit_is_an_error(spark):
    log = spark.createDataFrame([("a", 5, 1), ("a", 3, 2), ("a", 5, 3), ("b", 5, 4)], "channel string, wanted long, at long")
    once = requests.distinct_requests(log, ["channel"], "wanted", "at", limit=2)
    assert sorted(map(tuple, once.select("channel", "wanted", "at").collect())) == [("a", 3, 2), ("a", 5, 1), ("b", 5, 4)]
    with pytest.raises(PySparkException):
        requests.distinct_requests(log, ["channel"], "wanted", "at", limit=1).collect()


def test_chunks_follow_anchors_and_second_members_are_first_differences(spark):
    codes = difference.chunked(spark.createDataFrame([("a", p, p * p) for p in range(1, 12)], "channel string, pos long, code int"), 5)
    chunks = {r.pos: r.chunk for r in codes.collect()}
    assert [chunks[p] for p in range(1, 12)] == [0] * 5 + [1] * 5 + [2]
    deltas = {r.pos: r.delta for r in difference.delta(codes, 2).collect()}
    assert [deltas[p] for p in range(1, 6)] == [1, 3, 2, 2, 2]
    assert {r.pos: r.back for r in difference.restored(difference.delta(codes, 2), 2).collect()} == {p: p * p for p in range(1, 12)}


def test_settings_may_only_grow():
    stored = {"expected_frames": 101, "stride": 25, "windows": {"w": [10, 30]}}
    assert encoder.may_follow(stored, dict(stored))
    assert encoder.may_follow(stored, stored | {"expected_frames": 151, "windows": {"w": [10, 50]}})
    assert not encoder.may_follow(stored, stored | {"windows": {"w": [10, 50]}})
    assert not encoder.may_follow(stored, stored | {"expected_frames": 51})
    assert not encoder.may_follow(stored, stored | {"expected_frames": 151, "windows": {"w": [10, 20]}})
    assert not encoder.may_follow(stored | {"finalized": True}, stored | {"expected_frames": 151})


def test_attributes_between_anchors(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, 5, 0.5), (1, 4, 0.5), (0, 10, 0.26)], "a long, b long, w double")
    told = rows.select(requests.attribute_between(F.col("a"), F.col("b"), F.col("w"), whole=True).alias("k"), requests.listed_tau(F.array(F.lit(0.1), F.lit(0.2)), F.lit(0.9), F.col("a") + 2).alias("t"), requests.physical_time(F.lit(None).cast("double"), F.col("w")).alias("time"))
    assert [tuple(r) for r in told.collect()] == [(2, 0.2, 0.5), (2, 0.9, 0.5), (3, 0.2, 0.26)]


def test_public_names():
    assert {"bracket", "encode", "decode", "delta", "distinct_requests", "session"} <= set(lattiq.__all__)
