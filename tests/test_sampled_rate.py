"""Rolling rates by the last sampled snapshot, against a loop over each job."""

import datetime as dt
import random

import pytest

from framelane.operators.sampled_rate import sampled_throughput

SCHEMA = "job_id string, n long, ts timestamp, processed_frames long, total_frames long"
START = dt.datetime(2024, 1, 1, 0, 0, 7)


def looped(rows, min_gap):
    out = {}
    for job in {r[0] for r in rows}:
        held = rate = None
        for _, n, ts, done, _ in sorted((r for r in rows if r[0] == job and r[2] is not None), key=lambda r: (r[2], r[1])):
            done = done or 0
            if held is None:
                held = ts, done
            elif (gap := (ts - held[0]).total_seconds()) >= min_gap:
                rate, held = max(0, done - held[1]) / gap, (ts, done)
            out[n] = rate
    return out | {r[1]: None for r in rows if r[2] is None}


@pytest.mark.parametrize("block_seconds,min_gap", [(3, 1.0), (7, 20.0), (3600, 2.5), (10, 0.25)])
def test_rates_of_sampled_snapshots(spark, block_seconds, min_gap):
    """Ties, blocks without a sample, gaps longer than a block, null jobs, times and counts."""
    rng = random.Random(block_seconds)
    rows, n = [], 0
    for job in ("a", "b", None):
        at = 0.0
        for _ in range(120):
            at += rng.choice([0, 0.125, 0.25, 0.5, 1, 2, 9, 40] if job != "b" else [0.125, 0.25])
            done = rng.choice([None, *range(0, 4000, 7)])
            rows.append((job, n, START + dt.timedelta(seconds=at) if rng.random() > 0.03 else None, done, 5000))
            n += 1
    got = sampled_throughput(spark.createDataFrame(rows, SCHEMA), order=("ts", "n"), min_gap=min_gap, block_seconds=block_seconds).collect()
    assert len(got) == len(rows)
    want = looped(rows, min_gap)
    assert {r.n: r.rolling_fps and round(r.rolling_fps, 9) for r in got} == {k: v and round(v, 9) for k, v in want.items()}


def test_no_snapshots(spark):
    assert sampled_throughput(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_key_is_gathered(spark):
    """What is known of a key is kept over Arrow batches of two blocks, and keys follow each other in one partition."""
    rows = [(f"j{k}", 40 * k + i, START + dt.timedelta(seconds=2 * i + k % 3), 7 * i * (k + 1), 900) for k in range(6) for i in range(40)]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(batch)
    spark.conf.set(batch, "2")
    try:
        got = sampled_throughput(spark.createDataFrame(rows, SCHEMA), order=("ts", "n"), min_gap=5.0, block_seconds=6)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
        rates = {r.n: r.rolling_fps and round(r.rolling_fps, 9) for r in got.collect()}
    finally:
        spark.conf.set(batch, held)
    assert rates == {k: v and round(v, 9) for k, v in looped(rows, 5.0).items()}
