"""The codec as a stream: groups of pictures are kept in state until they are whole, then encoded like a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import codec
from ..session import ship

FRAME = "channel string, gop long, pos long, time double, value double"


def with_groups(frames: DataFrame, stride: int) -> DataFrame:
    """Each frame under every group that waits for it: its own, for an anchor the one it ends, and for an anchor's successor the ended one as a witness."""
    own = F.floor(F.col("pos") / stride)
    keys = F.when(F.col("pos") % stride < 2, F.array(own, own - 1)).otherwise(F.array(own))
    return frames.withColumn("gop", F.explode(keys)).filter("gop >= 0").select("channel", "gop", "pos", "time", "value")


def collect_group(stride: int, last: int | None):
    """State of a group: its frames so far.  Repeats are ignored, also after the group went out.

    A group goes out when all its frames and one after its end are there; the last group of a
    known length needs none after it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        channel, gop = key
        done, pos, time, value = state.get if state.exists else (False, [], [], [])
        if done:
            for _ in batches:
                pass
            return
        known = {p: (t, v) for p, t, v in zip(pos, time, value, strict=True)}
        for batch in batches:
            for p, t, v in zip(batch["pos"], batch["time"], batch["value"], strict=True):
                known.setdefault(int(p), (float(t), float(v)))
        end = (gop + 1) * stride if last is None else min((gop + 1) * stride, last)
        whole = all(p in known for p in range(gop * stride, end + 1)) and end - gop * stride >= 2
        if whole and (end + 1 in known or end == last):
            rows = [(channel, gop, p, *known[p]) for p in range(gop * stride, end + 1)]
            state.update((True, [], [], []))
            yield pd.DataFrame(rows, columns=["channel", "gop", "pos", "time", "value"])
        else:
            order = sorted(known)
            state.update((False, order, [known[p][0] for p in order], [known[p][1] for p in order]))

    return step


def complete_groups(frames: DataFrame, stride: int, last: int | None = None) -> DataFrame:
    """Streaming (channel, gop, pos, time, value) of whole groups, each once."""
    ship(frames.sparkSession)
    grouped = with_groups(frames, stride).groupBy("channel", "gop")
    state = "done boolean, pos array<long>, time array<double>, value array<double>"
    return grouped.applyInPandasWithState(collect_group(stride, last), FRAME, state, "append", GroupStateTimeout.NoTimeout)


def encode_groups(groups: DataFrame, bits: int = 8, percentile: float = 99.9, log_space: bool = True) -> DataFrame:
    """Codes of whole groups; start and end are the group's own first and last frame."""
    ends = groups.groupBy("channel", "gop").agg(F.min(F.struct("pos", "time", "value")).alias("a"), F.max(F.struct("pos", "time", "value")).alias("b"))
    told = groups.join(ends, ["channel", "gop"]).filter("pos > a.pos and pos < b.pos")
    told = told.select("channel", "gop", "pos", "time", "value", F.col("a.time").alias("start_time"), F.col("a.value").alias("start_value"), F.col("b.time").alias("end_time"), F.col("b.value").alias("end_value"))
    told = told.withColumn("tau", codec.N.tau_of(F.col("time"), F.col("start_time"), F.col("end_time")))
    return codec.encoded(codec.predicted(told, log_space), bits, percentile)


def start(frames: DataFrame, folder: str, checkpoint: str, stride: int = 25, last: int | None = None, **settings) -> StreamingQuery:
    """Encode a stream of (channel, pos, time, value) to ``folder``; a batch that is run again overwrites its own part."""

    def write(batch: DataFrame, number: int) -> None:
        encode_groups(batch, **settings).select("channel", "gop", "pos", "time", "tau", "scale", "code", "exception").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return complete_groups(frames, stride, last).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def may_follow(stored: dict, asked: dict) -> bool:
    """Whether a run may go on with new settings: the same ones, or more frames with windows that end no earlier; nothing after it was finished."""
    if stored == asked:
        return True
    if stored.get("finalized"):
        return False
    free = ("expected_frames", "windows", "finalized")
    if any(stored.get(k) != asked.get(k) for k in {*stored, *asked} if k not in free):
        return False
    if asked.get("expected_frames", 0) <= stored.get("expected_frames", 0):
        return False
    old, new = stored.get("windows", {}), asked.get("windows", {})
    return old.keys() == new.keys() and all(new[k][0] == old[k][0] and new[k][1] >= old[k][1] for k in old)


def retained(frames: DataFrame, every: int, windows: list[tuple[str, float, float]]) -> DataFrame:
    """(channel, pos, reason) of frames to keep: every so many, and those inside named windows."""
    base = frames.filter(F.col("pos") % every == 0).select("channel", "pos", F.lit("baseline").alias("reason"))
    slack = lambda end: F.lit(1e-8) * F.greatest(F.lit(1.0), F.abs("time"), F.lit(abs(end)))
    for name, begin, end in windows:
        base = base.unionByName(frames.filter((F.col("time") >= begin - slack(end)) & (F.col("time") <= end + slack(end))).select("channel", "pos", F.lit(name).alias("reason")))
    return base


def write_retained(frames: DataFrame, path: str, every: int, windows: list[tuple[str, float, float]], mode: str = "append") -> None:
    """Copy the frames that retention keeps, with the reasons as a list; a frame is there once."""
    why = retained(frames, every, windows).groupBy("channel", "pos").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    frames.join(why, ["channel", "pos"]).write.mode(mode).parquet(path)
