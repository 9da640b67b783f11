"""Rolling rates that are renewed at sampled snapshots only, over batches of any length."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from framelane.operators.ordered import time_block
from framelane.operators.telemetry import throughput

PATHS = "_key string, _block bigint, entry array<bigint>, entry_frames array<bigint>, exit array<bigint>, exit_frames array<bigint>, exit_rate array<double>"
ENTERED = "_key string, _block bigint, _sampled bigint, _sampled_frames bigint, _carried double"
RATES = "_key string, _block bigint, _us bigint, _rate double"


def _rate(frames: int, before: int, micros: int) -> float:
    return max(0, int(frames) - int(before)) / (int(micros) / 1e6)


def _paths(gap: int, block_micros: int):
    """Block -> for every instant that may be its first sample, the last sample that follows from it and the rate there.

    The sample before lies in an earlier block, so the first one here is at most the first instant ``gap`` after the start.
    """

    def one(block, us, frames):
        n, j = len(us), len(us)
        last, before = [0] * n, [-1] * n
        for i in reversed(range(n)):
            while j > i + 1 and us[j - 1] >= us[i] + gap:
                j -= 1
            last[i] = i if j == n else last[j]
            before[i] = -1 if j == n else i if before[j] < 0 else before[j]
        entries = min(n, bisect_left(us, block * block_micros + gap) + 1)
        ends = last[:entries]
        rates = [_rate(frames[k], frames[before[i]], us[k] - us[before[i]]) if before[i] >= 0 else None for i, k in enumerate(ends)]
        return us[:entries], frames[:entries], [us[k] for k in ends], [frames[k] for k in ends], rates

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(key, block, *one(block, us.tolist(), frames.tolist())) for key, block, us, frames in part.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["_key", "_block", "entry", "entry_frames", "exit", "exit_frames", "exit_rate"])

    return run


def _enter(gap: int):
    """Blocks in order of key and time -> the last sample, its frames and the rate before each block; one short row a block.

    A partition holds whole keys, so what is known of a key is kept over the batches; no key is gathered.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = sampled = frames = rate = None
        for part in parts:
            rows = []
            for key, block, entry, entry_frames, exits, exit_frames, exit_rate in part.itertuples(index=False):
                if key != current:
                    current, sampled, frames, rate = key, None, None, None
                rows.append((key, block, sampled, frames, rate))
                i = 0 if sampled is None else bisect_left(entry, sampled + gap)
                if i == len(entry):
                    continue
                if exit_rate[i] is not None and not math.isnan(exit_rate[i]):
                    rate = float(exit_rate[i])
                elif sampled is not None:
                    rate = _rate(entry_frames[i], frames, entry[i] - sampled)
                sampled, frames = int(exits[i]), int(exit_frames[i])
            out = pd.DataFrame(rows, columns=["_key", "_block", "_sampled", "_sampled_frames", "_carried"])
            yield out.astype({"_sampled": "Int64", "_sampled_frames": "Int64", "_carried": "Float64"})

    return run


def _renewals(gap: int):
    """Block and what it starts from -> the instants at which the rate is renewed; the rate it starts with comes first."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, block, us, frames, sampled, sampled_frames, carried in part.itertuples(index=False):
                us, frames = us.tolist(), frames.tolist()
                if not pd.isna(carried):
                    rows.append((key, block, us[0] - 1, float(carried)))
                at, before = (0, None) if pd.isna(sampled) else (bisect_left(us, int(sampled) + gap), (int(sampled), int(sampled_frames)))
                while at < len(us):
                    if before is not None:
                        rows.append((key, block, us[at], _rate(frames[at], before[1], us[at] - before[0])))
                    before = (us[at], frames[at])
                    at = bisect_left(us, us[at] + gap, at)
            yield pd.DataFrame(rows, columns=["_key", "_block", "_us", "_rate"]).astype({"_key": object, "_block": "int64", "_us": "int64", "_rate": "float64"})

    return run


def sampled_throughput(
    progress: DataFrame,
    keys: Sequence[str] = ("job_id",),
    ts: str = "ts",
    order: Sequence[str] = ("ts",),
    processed: str = "processed_frames",
    total: str = "total_frames",
    min_gap: float = 1.0,
    block_seconds: int = 3_600,
) -> DataFrame:
    """``throughput`` with the rolling rate of the stream: against the last *sampled* snapshot, kept until the next sample.

    The first snapshot of a job is sampled, then the first one ``min_gap`` seconds or more after the last sample. Which
    snapshots are sampled depends on all before, so each time block is solved for every instant at which its first sample
    can be, the blocks of a job are chained by one short row each, and then every block is finished by itself. Snapshots of one instant
    count as the first of them in ``order``; without a time they have no rate. Missing frame counts are 0.
    """
    gap = max(1, round(min_gap * 1e6))
    placed = {"_key": F.to_json(F.struct(*keys)), "_us": F.unix_micros(F.col(ts).cast("timestamp")), "_block": time_block(ts, block_seconds)}
    instants = (
        progress.withColumns(placed)
        .where(F.col("_us").isNotNull())
        .groupBy("_key", "_block", "_us")
        .agg(F.min_by(F.coalesce(F.col(processed).cast("bigint"), F.lit(0)), F.struct(*order)).alias("_frames"))
    )
    line = F.array_sort(F.collect_list(F.struct("_us", "_frames"))).alias("_line")
    lines = instants.groupBy("_key", "_block").agg(line).select("_key", "_block", F.col("_line._us").alias("_at"), F.col("_line._frames").alias("_counts"))
    paths = lines.mapInPandas(_paths(gap, block_seconds * 1_000_000), PATHS)
    entered = paths.repartition("_key").sortWithinPartitions("_key", "_block").mapInPandas(_enter(gap), ENTERED)
    rates = lines.join(entered, ["_key", "_block"]).mapInPandas(_renewals(gap), RATES)
    rows = throughput(progress, keys, ts, order, processed, total, min_gap, block_seconds).drop("rolling_fps").withColumns(placed)
    both = rows.withColumn("_n", F.lit(1)).unionByName(rates.withColumn("_n", F.lit(0)), allowMissingColumns=True)
    past = Window.partitionBy("_key", "_block").orderBy("_us", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rated = both.withColumn("rolling_fps", F.last("_rate", ignorenulls=True).over(past)).where("_n = 1")
    return rated.drop("_key", "_us", "_block", "_n", "_rate")
