"""Runs over states, reports and the command line."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lattiq import __main__ as line
from lattiq.operators import schemes
from lattiq.plans import states


def _states(spark):
    rows = [(f, 0, k, p, p + 0.1 * (p % 3), 2.0 + math.sin(p * 0.3 + k)) for f in ("rho", "B") for p in range(9) for k in range(8)]
    return spark.createDataFrame(rows, "field string, block int, cell int, pos long, time double, value double")


def test_a_run_of_states_comes_back(spark, tmp_path):
    frames = _states(spark)
    chosen = [schemes.Scheme("a8", {"B": 16}, {}, {"rho": (2, 2, 1)}, default_percentile=100.0), schemes.Scheme("b4", default_bits=4)]
    states.encode_states(frames, str(tmp_path / "run"), chosen, 4, ("rho", "B"), (2, 2, 2))
    back = states.decode_states(spark, str(tmp_path / "run")).join(frames, states.KEYS)
    told = back.agg(F.count("*"), F.max(F.abs(F.col("reconstructed") - F.col("value"))), F.count_if("exact")).first()
    assert told[0] == 144 and told[1] < 0.02 and told[2] == 48
    errors = {(r.scheme, r.field): r.rmse for r in spark.read.json(str(tmp_path / "run" / "errors")).collect()}
    assert errors["a8", "B"] < errors["b4", "B"] and errors["a8", "rho"] < errors["b4", "rho"]
    sizes = {(r.scheme, r.field): r.bytes for r in spark.read.json(str(tmp_path / "run" / "sizes")).collect()}
    assert sizes["a8", "B"] == 6 * (8 * 2 + 4) and sizes["a8", "rho"] == 6 * (8 + 2 * 4)


def test_reports_and_lists(spark, tmp_path):
    frames = spark.range(41).select(F.lit("x").alias("channel"), F.col("id").alias("pos"), (F.col("id") * 1.0).alias("time"), (F.sin("id") + 3).alias("value"))
    report = states.comparison_report(states.comparison(frames, 20, [5, 10], 8, 99.9)).first()
    told = json.loads(report.report)
    assert sorted(told) == ["codec", "every_10", "every_5"] and {m["cnt"] for m in told.values()} == {38}
    states.window_lists(frames.withColumn("path", F.concat(F.lit("f"), "pos")), str(tmp_path / "w"), 3, 5)
    assert [r.value for r in spark.read.text(str(tmp_path / "w" / "paths")).collect()] == ["f3", "f4", "f5"]
    frames.write.parquet(str(tmp_path / "t"))
    assert ("pos", "bigint") in {(r.column, r.type) for r in states.layout(spark.read.parquet(str(tmp_path / "t"))).collect()}


def test_command_line_settings():
    args = line.parsed(["encode-states", "a", "b", "--bits", "B=12", "--tiles", "u=4x4x4"])
    told = line.state_scheme(args)
    assert told.bits == {"rho": 8, "u": 8, "uvec": 5, "B": 12} and told.tiles == {"u": (4, 4, 4)}
    assert line.state_scheme(line.parsed(["encode-states", "a", "b", "--profile", "custom"])).bits == {}
    with pytest.raises(SystemExit):
        line.parsed(["nonsense", "a", "b"])
