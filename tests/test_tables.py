"""Sources, sinks, whole runs and the stream."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import codec
from lattiq.plans import sequence
from lattiq.sources import archive, listing, sinks, synthetic
from lattiq.streaming import encoder


@pytest.fixture
def frames(spark):
    cell = synthetic.sequence(spark, 51, (2, 2, 4)).filter("cell = 3")
    return cell.select(F.lit("rho").alias("channel"), F.col("sequence").alias("pos"), "time", F.col("rho").alias("value"))


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_a_run_comes_back(spark, frames, tmp_path):
    folder = str(tmp_path / "run")
    sequence.encode(frames, folder)
    back = sequence.decode(spark, folder)
    joined = back.join(frames, ["channel", "pos"]).collect()
    assert len(joined) == 51
    assert all(abs(r.reconstructed - r.value) < 2e-3 if not r.exact else r.reconstructed == r.value for r in joined)
    assert {r.failures for r in sequence.verify(spark, folder, frames).collect()} == {0}
    some = sequence.decode(spark, folder, positions=[0, 7, 30])
    assert rows(some, "pos", "reconstructed") == rows(back.filter("pos in (0, 7, 30)"), "pos", "reconstructed")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_anchors(frames, 25, f"{folder}/anchors")
    manifest = spark.read.json(f"{folder}/manifest").first()
    assert manifest.frames == 48 and len(manifest.gops) == 2


def test_the_stream_gives_what_the_batch_gives(spark, frames, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    told = frames.orderBy("pos").collect()
    schema = "channel string, pos long, time double, value double"
    batch = codec.encoded(codec.predicted(codec.endpoint_join(frames, 10)))

    def put(some):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        encoder.start(stream, out, state, stride=10, last=50).awaitTermination()
        return spark.read.parquet(out)

    put(told[:17] + told[12:15])
    first = run()
    assert rows(first.select("gop").distinct(), "gop") == [(0,)]
    put(told[25:] + told[:5])
    put(told[17:25])
    assert rows(run(), "pos", "code") == rows(batch, "pos", "code")


def test_settings_may_grow_only():
    old = {"stride": 25, "expected_frames": 101, "windows": {"a": [10, 30]}}
    assert encoder.may_follow(old, old | {"expected_frames": 151, "windows": {"a": [10, 50]}})
    assert not encoder.may_follow(old, old | {"expected_frames": 51})
    assert not encoder.may_follow(old, old | {"windows": {"a": [10, 20]}})
    assert not encoder.may_follow(old, old | {"stride": 5})
    assert not encoder.may_follow(old | {"finalized": True}, old | {"expected_frames": 151})


def test_retention(spark, frames):
    kept = encoder.retained(frames, 20, [("w", 1.0, 1.2)])
    assert {r.pos for r in kept.filter("reason = 'baseline'").collect()} == {0, 20, 40}
    assert 0 < kept.filter("reason = 'w'").count() <= 3


def test_archives_are_read_and_checked(spark, tmp_path):
    data = io.BytesIO()
    np.save(data, np.asfortranarray(np.arange(6, dtype="<i2").reshape(2, 3)))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("frames/00001/rho_q8.npy", data.getvalue())
        z.writestr("metadata.json", "{}")
    found = {r.member: r for r in archive.read_archives(spark, str(tmp_path)).collect()}
    array = found["frames/00001/rho_q8.npy"]
    assert array.shape == [2, 3] and np.frombuffer(array.payload, array.dtype).tolist() == list(range(6))
    assert bytes(found["metadata.json"].payload) == b"{}"
    with pytest.raises(ValueError):
        archive.array_member(data.getvalue()[:-1])
    bad = io.BytesIO()
    np.save(bad, np.array([None], object), allow_pickle=True)
    with pytest.raises(ValueError):
        archive.array_member(bad.getvalue())


def test_listing(spark, tmp_path):
    for k in range(7):
        (tmp_path / f"torus.out0.{k:05d}.phdf").write_text("x" * (k + 1))
    (tmp_path / "torus.out0.final.phdf").write_text("")
    found = listing.sequence_files(spark, str(tmp_path), 1, 5)
    assert rows(found, "sequence", "size_bytes") == [(k, k + 1) for k in range(1, 6)]
    with pytest.raises(ValueError):
        listing.sequence_files(spark, str(tmp_path), 1, 2)
    strided = listing.strided_files(spark, str(tmp_path), 2, "*.phdf")
    assert [r[0] for r in rows(strided, "sequence")] == [0, 2, 4, 6]
    assert listing.same_index(strided, strided) and not listing.same_index(strided, found)
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"frames": [{"sequence": 1, "time": 0.5, "path": "p", "exact_keyframe": True}]}))
    assert rows(listing.checked_index(listing.manifest_frames(spark, str(manifest))), "sequence", "time", "size_bytes") == [(1, 0.5, None)]
    manifest.write_text("{}")
    with pytest.raises(ValueError):
        listing.manifest_frames(spark, str(manifest))


def test_slabs_are_skipped(spark, tmp_path):
    long = synthetic.sequence(spark, 2, (2, 2, 8)).select("sequence", "cell", "rho")
    sinks.write_slabs(long, str(tmp_path / "s"), slab=4, nr=8)
    inner = sinks.read_region(spark.read.parquet(str(tmp_path / "s")), 4)
    assert {r.cell % 8 for r in inner.collect()} == {0, 1, 2, 3}
    assert "slab_begin" in inner._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
