"""Operators on small fixtures with values known by other means."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattiq.functions import numeric as N
from lattiq.functions import parameters as P
from lattiq.operators import arrays, audit, codec, difference, index, lifecycle


def values(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def series(spark, rows):
    return spark.createDataFrame(rows, "channel string, pos long, time double, value double")


def test_uneven_times_of_a_straight_line_leave_no_residual(spark):
    frames = series(spark, [("a", 0, 0.0, 0.0), ("a", 1, 0.2, 2.0), ("a", 2, 1.0, 10.0)])
    (row,) = codec.predicted(codec.endpoint_join(frames, 2), log_space=False).collect()
    assert row.tau == pytest.approx(0.2) and row.residual == pytest.approx(0.0)


def test_prediction_in_log_space_is_a_geometric_mean(spark):
    frames = series(spark, [("a", 0, 0.0, 2.0), ("a", 1, 0.5, 4.0), ("a", 2, 1.0, 8.0)])
    (row,) = codec.predicted(codec.endpoint_join(frames, 2)).collect()
    assert math.exp(row.prediction) == pytest.approx(4.0)


def test_reconstruction_is_within_half_a_scale_and_exceptions_are_exact(spark):
    rng = random.Random(17)
    rows = [("a", p, p * 0.1, rng.uniform(1, 2) if p != 13 else 900.0) for p in range(51)]
    out = codec.decoded(codec.encoded(codec.predicted(codec.endpoint_join(series(spark, rows), 25)), 8, 99.0)).collect()
    assert any(r.exception is not None for r in out)
    for r in out:
        assert r.dequantized == r.residual if r.exception is not None else abs(r.dequantized - r.residual) <= r.scale / 2 + 1e-12


def test_clipping_without_exceptions_at_the_100th_percentile(spark):
    rows = [("a", p, float(p), 1.0 + p % 7) for p in range(26)]
    out = codec.encoded(codec.predicted(codec.endpoint_join(series(spark, rows), 25)), 4, 100.0).collect()
    assert all(r.exception is None and abs(r.code) <= 7 for r in out)


def test_ties_go_to_even(spark):
    told = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "r double").select(N.quantized(F.col("r"), F.lit(1.0), 8).alias("c"))
    assert [r.c for r in told.collect()] == [2, 4, -2]
    with pytest.raises(ValueError):
        N.top_code(17)


def test_nibbles_come_back(spark):
    rows = [([-7, 7, 0],), ([1, -1],), ([],)]
    told = spark.createDataFrame(rows, "codes array<int>").withColumn("packed", N.packed_nibbles(F.col("codes"))).withColumn("back", N.unpacked_nibbles(F.col("packed"), F.size("codes")))
    for r in told.collect():
        assert r.back == r.codes and len(r.packed) == (len(r.codes) + 1) // 2


@pytest.mark.parametrize("order", [1, 2])
def test_differences_come_back_with_wraps(spark, order):
    rng = random.Random(42)
    rows = [("a", p, rng.randint(-128, 127)) for p in range(40)]
    codes = difference.chunked(spark.createDataFrame(rows, "channel string, pos long, code int"), 5)
    back = difference.restored(difference.delta(codes, order), order)
    assert values(back, "channel", "pos", "back") == rows


def test_zigzag_order(spark):
    told = spark.createDataFrame([(k,) for k in (0, -1, 1, -2, 2)], "d int").select("d", N.zigzag(F.col("d")).alias("z"), N.unzigzag(N.zigzag(F.col("d"))).alias("b"))
    assert [(r.z, r.b) for r in told.collect()] == [(0, 0), (1, -1), (2, 1), (3, -2), (4, 2)]


def test_second_order_wins_on_quadratic_series(spark):
    rows = [("a", p, 3 * p * p // 2) for p in range(5)]
    (best,) = difference.adaptive_order(difference.chunked(spark.createDataFrame(rows, "channel string, pos long, code int"), 5)).collect()
    assert best.order == 2


def test_brackets(spark):
    frames = series(spark, [("a", 0, 10.0, 1.0), ("a", 1, 10.1, 2.0), ("a", 2, 10.2, 3.0)])
    asked = spark.createDataFrame([("a", 10.15), ("a", 10.1 + 1e-11), ("a", 9.9), ("a", 10.3), ("b", 10.1)], "channel string, request double")
    for width in (0.05, 100.0):
        found = {round(r.request, 6): r for r in index.bracket(asked, frames, width).collect()}
        assert set(found) == {10.15, 10.1}
        assert (found[10.15].lower_pos, found[10.15].upper_pos) == (1, 2) and found[10.15].upper_weight == pytest.approx(0.5)
        assert found[10.1].is_exact and found[10.1].lower_pos == found[10.1].upper_pos == 1 and found[10.1].upper_weight == 0.0
    assert values(index.out_of_range(asked, frames), "request") == [(9.9,), (10.3,)]


def test_covering_range_has_two_frames(spark):
    frames = series(spark, [("a", k, float(k), 0.0) for k in range(4)])
    find = lambda a, b: values(index.covering_range(frames, F.lit(a), F.lit(b)), "first_pos", "last_pos")
    assert find(0.5, 1.5) == [(0, 2)] and find(1.0, 1.0) == [(1, 2)] and find(3.0, 3.0) == [(2, 3)] and find(-1.0, 1.0) == []


def test_groups_share_ends_and_drop_tails_without_middle(spark):
    frames = series(spark, [("a", k, float(k), 0.0) for k in range(12)] + [("b", k, float(k), 0.0) for k in range(11)])
    assert values(index.gop_ranges(frames, ["channel"], 5), "channel", "start", "end") == [("a", 0, 5), ("a", 5, 10), ("b", 0, 5), ("b", 5, 10)]
    assert {r[0] for r in values(index.gop_ranges(frames, ["channel"], 5, allow_short=False), "channel")} == {"b"}


def test_sums_come_before_ratios(spark):
    rows = spark.createDataFrame([("x", 2.0, 8.0, 2), ("x", 6.0, 24.0, 2)], "m string, sse double, target_sse double, cnt int").selectExpr("m", "sse", "0D AS sae", "target_sse", "1D AS target_abs", "cnt", "0D AS min_value", "0D AS max_abs_error")
    (r,) = codec.metrics(codec.merged(rows, ["m"]), ["m"]).collect()
    assert r.rmse == pytest.approx(math.sqrt(2), abs=1e-6) and r.nrmse == 0.5


def test_tiles_and_regions(spark):
    told = spark.range(64).select(N.tile_of(F.col("id"), (4, 4, 4), (2, 2, 2)).alias("t"), "id").collect()
    for r in told:
        phi, theta, rad = r.id // 16, r.id // 4 % 4, r.id % 4
        assert r.t == ((phi // 2) * 2 + theta // 2) * 2 + rad // 2
    with pytest.raises(ValueError):
        N.tile_of(F.lit(0), (4, 4, 4), (3, 2, 2))
    cells = spark.range(1).select(N.log_grid_cells(F.lit(100.0), 0.169937, 6.907755, 288).alias("n")).first().n
    assert cells == 192
    moved = arrays.remap_exceptions(spark.createDataFrame([(0,), (3,), (6,)], "idx long"), nr=4, stop=3)
    assert values(moved, "idx", "new_idx") == [(0, 0), (6, 5)]


def test_history_and_retention(spark):
    segments = spark.createDataFrame([("r", "a", 3), ("r", "b", 3)], "run string, seg string, n long")
    assert values(lifecycle.allocation(segments, ["run"], "seg", "n", 5), "seg", "kept") == [("a", 3), ("b", 2)]
    frames = series(spark, [("a", k, float(k), 0.0) for k in range(9)])
    assert lifecycle.rollback(frames, 4, 4).count() == 4
    with pytest.raises(ValueError):
        lifecycle.rollback(frames, 5, 4)
    with pytest.raises(ValueError):
        lifecycle.rollback(frames, 4, 4, ghost=False)


def test_audits_find_faults(spark):
    frames = series(spark, [("a", 0, 0.0, 1.0), ("a", 1, 2.0, float("nan")), ("a", 2, 1.0, float("inf")), ("a", 3, 3.0, None)])
    assert values(audit.monotonic(frames), "violations") == [(1,)]
    assert values(audit.finite(frames, ["channel"], "value"), "non_finite", "missing") == [(2, 1)]


def test_parameters(spark):
    lines = spark.createDataFrame([("f", 0, "<job>"), ("f", 1, "a-b = 1 # note"), ("f", 2, ""), ("f", 3, "<mesh>"), ("f", 4, "nx1 128"), ("g", 0, "<job>"), ("g", 1, "a_b=2")], "file string, line_no int, text string")
    told = P.read_parameters(lines).withColumn("rank", (F.col("file") == "g").cast("int"))
    assert values(P.effective_parameters(told), "section", "key", "value") == [("job", "a_b", "2"), ("mesh", "nx1", "128")]
    assert "nx1 = 64" in P.rewritten("<mesh>\nnx1 = 128\n", "mesh", {"nx1": "64"})
    with pytest.raises(KeyError):
        P.rewritten("<mesh>\nnx1 = 128\n", "mesh", {"nx2": "64"})
    with pytest.raises(ValueError):
        P.scheme_config({"rho": 3}, {}, {}, ("rho",))
    assert N.scheme_tag({"rho": 8, "u": 8, "uvec": 5}, {"B": 99.5}) == "q8_uvec5_Bp99p5"


@pytest.mark.parametrize("kind", ["bzip2", "xz", "deflate"])
def test_codecs_come_back(spark, kind):
    from lattiq.functions import codecs as C

    table = spark.createDataFrame([(bytearray(range(240)),), (bytearray(b""),), (None,)], "b binary")
    told = table.withColumn("z", C.compressed(C.byte_planes(F.col("b"), 4), kind)).withColumn("back", C.from_byte_planes(C.decompressed(F.col("z"), kind), 4)).collect()
    assert all(r.back == r.b for r in told)
    with pytest.raises(Exception, match="checksum"):
        table.select(C.checked(F.col("b"), F.lit(1))).collect()


def test_checkpoint_layouts(spark):
    from lattiq.operators import checkpoints as K

    rows = [("a", [128, 64, 64], [64, 32, 32], 8, [4, 4]), ("b", [128, 64, 64], [60, 32, 32], 8, None), ("c", [128, 64, 64], [64, 32, 32], 8, [4, 3])]
    table = spark.createDataFrame(rows, "path string, mesh array<int>, block array<int>, n_blocks long, blocks_per_process array<int>")
    assert [r[0] for r in values(K.layout_errors(table), "path")] == ["b", "c"]
    assert spark.range(1).select(K.last_frame(F.lit(10.3), F.lit(10.0), F.lit(0.1)).alias("n")).first().n == 3
    sums = K.repack_rollup(spark.createDataFrame([("q8", 100, 60), ("q8", 300, 140)], "scheme string, bytes_before long, bytes_after long"))
    assert values(sums, "scheme", "saved") == [("q8", 0.5)]
