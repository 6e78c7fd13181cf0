"""Time the headline queries: one JSON line with seconds by query, after a warm-up at the smallest scale; ``duckdb`` has the same queries' SQL on as many threads."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from lattiq import catalog  # noqa: E402
from lattiq.session import session  # noqa: E402

HEADLINE = ["frame_positions", "bracket_lookup", "endpoint_predict", "encode_gop", "reconstruct", "codec_errors", "delta_roundtrip", "tile_scale", "compare_methods", "sha256_digest", "latest_checkpoint", "anchor_priority"]


def baseline(folder: str, cpus: str) -> dict[str, float]:
    """Seconds of each query's SQL in DuckDB, the better of two runs, all rows fetched; empty without DuckDB."""
    try:
        import duckdb
    except ModuleNotFoundError:
        return {}
    base = duckdb.connect()
    base.execute(f"SET threads TO {cpus if cpus.isdigit() else 8}")
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            base.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{name}')")
    took = {}
    for name in HEADLINE:
        best = []
        for _ in range(2):
            began = time.perf_counter()
            base.execute(catalog.SQL[name]).fetchall()
            best.append(time.perf_counter() - began)
        took[name] = round(min(best), 3)
    return took


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(folder), "sf0.001")
    took = {}
    for name in HEADLINE:
        f = catalog.QUERIES[name]
        f(spark, warm if os.path.isdir(warm) else folder).write.format("noop").mode("overwrite").save()
        best = []
        for _ in range(2):
            began = time.perf_counter()
            f(spark, folder).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        took[name] = round(min(best), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(folder).removeprefix("sf") or 0), "duckdb": baseline(folder, cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
