"""Command line: ``python -m lattiq COMMAND SOURCE TARGET [options]``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from . import catalog
from .operators import schemes
from .plans import rollback, sequence, states
from .session import session
from .sources import members, runs
from .streaming import encoder

SERIES = {"local-u8": sequence.LOCAL, "fine-u16": sequence.Profile(bits=16, percentile=100.0), "linear-u8": sequence.Profile(log_space=False)}
STATES = {"local-u8": schemes.LOCAL_U8, "legacy-u8": schemes.LEGACY_U8}
COMMANDS = {
    "encode": "series (channel, pos, time, value) as Parquet to a run's folder",
    "encode-states": "states (field, block, cell, pos, time, value) as Parquet to a run's folder, under one scheme or more",
    "decode": "a run's folder to Parquet",
    "decode-states": "a run of states to Parquet",
    "verify": "a run's folder against its series; prints failures",
    "watch": "a folder that series are written to, as a stream, to a folder of codes; the checkpoint lies beside it",
    "compare": "series to a JSON report of the codec beside sparser cadences",
    "finish": "a run's folder and its series: hold them together, write digests and the marker",
    "check": "a finished run; prints files that changed",
    "wait": "a run's folder; returns when it is finished",
    "rollback": "a run's folder to a new one, as it was at the checkpoint --to of --checkpoints",
    "repack": "a folder of members to another one with --chunk frames each and --codec",
    "inspect": "the layout of a table",
    "query": "a query's name, on the tables of a folder",
}


def parsed(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lattiq", formatter_class=argparse.RawDescriptionHelpFormatter, epilog="\n".join(f"{k}: {v}" for k, v in COMMANDS.items()))
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("source")
    parser.add_argument("target", nargs="?")
    parser.add_argument("--profile", choices=sorted({*SERIES, *STATES, "custom"}), default="local-u8")
    parser.add_argument("--bits", default="", help="by field, rho=8,u=8; a number for series")
    parser.add_argument("--percentiles", default="", help="by field, rho=99.9; a number for series")
    parser.add_argument("--tiles", default="", help="by field, u=8x16x32")
    parser.add_argument("--shape", default="16x16x32", help="cells of a block")
    parser.add_argument("--stride", type=int, default=25)
    parser.add_argument("--to", type=int, help="the last frame before the checkpoint to go back to")
    parser.add_argument("--checkpoints", help="JSON lines of checkpoint records")
    parser.add_argument("--chunk", type=int, default=5)
    parser.add_argument("--codec", choices=sorted(members.PACKERS), default="bzip2")
    parser.add_argument("--timeout", type=float, default=3600.0)
    parser.add_argument("--master", default="local[*]")
    return parser.parse_args(argv)


def series_profile(args: argparse.Namespace) -> sequence.Profile:
    base = SERIES.get(args.profile, sequence.LOCAL)
    return sequence.Profile(args.stride, int(args.bits or base.bits), float(args.percentiles or base.percentile), base.log_space)


def state_scheme(args: argparse.Namespace) -> schemes.Scheme:
    """The preset's settings with what is named on the command line over them; ``custom`` has no preset."""
    base = STATES.get(args.profile, schemes.Scheme(args.profile))
    return schemes.Scheme(base.name, base.bits | schemes.settings(args.bits), base.percentiles | schemes.settings(args.percentiles, float), base.tiles | schemes.settings(args.tiles))


def main(argv: list[str] | None = None) -> None:
    args = parsed(argv)
    spark = session(args.master)
    read = spark.read.parquet
    if args.command == "encode":
        sequence.encode(read(args.source), args.target, series_profile(args))
    elif args.command == "encode-states":
        states.encode_states(read(args.source), args.target, [state_scheme(args)], args.stride, ("rho", "u", "uvec", "B"), tuple(int(x) for x in args.shape.split("x")))
    elif args.command == "decode":
        sequence.decode(spark, args.source, series_profile(args)).write.parquet(args.target)
    elif args.command == "decode-states":
        states.decode_states(spark, args.source).write.parquet(args.target)
    elif args.command == "verify":
        sequence.verify(spark, args.source, read(args.target)).show()
    elif args.command == "watch":
        profile = series_profile(args)
        frames = spark.readStream.schema("channel string, pos long, time double, value double").parquet(args.source)
        encoder.start(frames, args.target, f"{args.target}_checkpoint", profile.stride, bits=profile.bits, percentile=profile.percentile, log_space=profile.log_space).awaitTermination()
    elif args.command == "compare":
        profile = series_profile(args)
        told = states.comparison(read(args.source), profile.stride, [5, 10], profile.bits, profile.percentile)
        states.comparison_report(told).write.json(args.target)
    elif args.command == "finish":
        runs.finalize(spark, args.source, read(args.target))
    elif args.command == "check":
        runs.integrity_errors(spark, args.source).show(truncate=False)
    elif args.command == "wait":
        print(json.dumps([r.asDict() for r in runs.wait_finished(spark, args.source, args.timeout).collect()]))
    elif args.command == "rollback":
        record = runs.read_checkpoints(spark, args.checkpoints).filter(F.col("last_sequence") == args.to).first()
        if record is None:
            raise SystemExit(f"no checkpoint after frame {args.to} in {args.checkpoints}")
        rollback.rollback(spark, args.source, args.target, record.asDict(), series_profile(args))
    elif args.command == "repack":
        old = read(args.source).drop("chunk_folder")
        members.write_members(members.repacked(old, args.chunk, args.codec, old.first().codec), args.target)
    elif args.command == "inspect":
        states.layout(read(args.source)).show(1000, truncate=False)
    else:
        catalog.QUERIES[args.source](spark, args.target).show(50, truncate=False)


if __name__ == "__main__":
    main()
