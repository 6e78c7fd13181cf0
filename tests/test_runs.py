"""Finished runs, rollback, checkpoints, history and regions on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from lattiq.functions import region
from lattiq.plans import rollback, sequence
from lattiq.sources import runs

PROFILE = sequence.Profile(stride=4)


@pytest.fixture()
def run(spark, tmp_path):
    frames = spark.range(13).select(F.lit("rho").alias("channel"), F.col("id").alias("pos"), (F.col("id") * 0.1).alias("time"), (F.col("id") % 5 + 1.0).alias("value"))
    sequence.encode(frames, str(tmp_path / "run"), PROFILE)
    return frames, tmp_path / "run"


def test_a_finished_run_is_held_against_its_digests(spark, run):
    frames, folder = run
    with pytest.raises(TimeoutError):
        runs.wait_finished(spark, str(folder), 0.2, 0.1)
    more = frames.unionByName(frames.limit(1).withColumn("channel", F.lit("rho")).withColumn("pos", F.lit(11).cast("long")))
    runs.finalize(spark, str(folder), more)
    assert [tuple(r) for r in runs.wait_finished(spark, str(folder), 5).select("channel", "frames", "last").collect()] == [("rho", 13, 12)]
    assert runs.integrity_errors(spark, str(folder)).isEmpty()
    with pytest.raises(ValueError):
        runs.finalize(spark, str(folder), frames)
    part = next(p for p in (folder / "anchors").iterdir() if p.suffix == ".parquet")
    part.with_name("extra.parquet").write_bytes(part.read_bytes())
    spoiled = next(folder.glob("codes/*/*.parquet"))
    spoiled.write_bytes(b"spoiled")
    spoiled.with_name(f".{spoiled.name}.crc").unlink(missing_ok=True)  # else the local file system finds it first
    assert sorted(r.error for r in runs.integrity_errors(spark, str(folder)).collect()) == ["changed", "unexpected"]


def test_a_run_that_lacks_frames_stays_open(spark, run):
    frames, folder = run
    lacking = frames.unionByName(frames.limit(1).withColumn("pos", F.lit(-1).cast("long")))
    with pytest.raises(ValueError, match="1 frames"):
        runs.finalize(spark, str(folder), lacking)
    assert not (folder / "finished").exists()


def test_rollback_keeps_whole_groups_and_lists_what_went(spark, run, tmp_path):
    _, folder = run
    history = tmp_path / "hist"
    history.mkdir()
    (history / "a.hst").write_text("# one\n# two\n0 x\n1 x\n2 x\n")
    (history / "b.hst").write_text("# other\n3 x\n4 x\n5 x\n")
    (history / "combined.hst").write_text("9 x\n")
    lines = runs.read_history(spark, str(history))
    target = str(tmp_path / "back")
    rollback.rollback(spark, str(folder), target, {"last_sequence": 8, "includes_ghost": True, "path": "c.8"}, PROFILE, lines, 5)
    told = {(r.part, r.side): (r.frames, r["first"], r["last"]) for r in spark.read.json(f"{target}/audit").collect()}
    assert told == {("codes", "kept"): (6, 1, 7), ("codes", "removed"): (3, 9, 11), ("anchors", "kept"): (3, 0, 8), ("anchors", "removed"): (1, 12, 12)}
    assert sorted(r.pos for r in sequence.decode(spark, target, PROFILE).collect()) == list(range(9))
    assert [r.text for r in spark.read.parquet(f"{target}/history").orderBy("segment", "line_no").collect()] == ["# one", "# two", "0 x", "1 x", "2 x", "3 x", "4 x"]
    for bad in ({"last_sequence": 7, "includes_ghost": True}, {"last_sequence": 8, "includes_ghost": False}, {"includes_ghost": True}):
        with pytest.raises(ValueError):
            rollback.rollback(spark, str(folder), str(tmp_path / "other"), bad, PROFILE)
    with pytest.raises(ValueError):
        rollback.rollback(spark, str(folder), target, {"last_sequence": 8, "includes_ghost": True}, PROFILE)


def test_checkpoints_take_sizes_from_their_parameters(spark, tmp_path):
    text = "<parthenon/mesh>\nnx1 = 64\nnx2 = 16 # cells\nnx3 = 8\n<parthenon/meshblock>\nnx1 = 32\nnx2 = 16\nnx3 = 8\n"
    records = [{"path": "a", "number": 1, "time": 0.5, "input": text}, {"path": "b", "number": 2, "mesh": [4, 4, 4], "block": [2, 2, 2]}, {"path": "c", "input": "<parthenon/mesh>\nnx1 = 4\n"}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, records)))
    got = {r.path: (r.mesh, r.block) for r in runs.read_checkpoints(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"a": ([64, 16, 8], [32, 16, 8]), "b": ([4, 4, 4], [2, 2, 2]), "c": (None, None)}


def test_regions_keep_the_spacing_or_are_refused():
    grid = region.Grid(0.169937, 6.907755, 288, 288)
    found = region.radial_region(grid, 100.0)
    assert found.cells == 192 and (found.last - grid.first) / found.cells == found.spacing == (grid.last - grid.first) / 288
    assert region.radial_region(grid, 1e6).last == grid.last
    for bad in (region.Grid(0.169937, 6.907755, 288, 144), region.Grid(0.1, 6.9, 288, 288, refinement="adaptive"), region.Grid(0.1, 6.9, 288, 288, ratio=1.1), region.Grid(6.9, 0.1, 8, 8)):
        with pytest.raises(ValueError):
            region.radial_region(bad, 100.0)
    for radius in (0.0, -1.0, float("inf"), 1.0):
        with pytest.raises(ValueError):
            region.radial_region(grid, radius)
    assert region.automatic_radius({"outer_radius": "50"}) == 50 and region.automatic_radius({}) is None
    region.hold_radius({"outer_radius": "40"}, 50.0)
    with pytest.raises(ValueError):
        region.hold_radius({"outer_radius": "60"}, 50.0)
