"""Streaming operators made of Spark's own aggregations and watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from framelane.operators.library import content_hash
from framelane.operators.telemetry import gpu_activity_aggregates, gpu_activity_verdict, parse_gpu_samples, window_rollup
from framelane.streaming.stateful import END_TIME


def stream_gpu_activity(
    samples: DataFrame, keys: Sequence[str] = ("run_id",), order: str = "sample_seq"
) -> DataFrame:
    """GPU activity of every run so far (update mode); the same aggregates as the batch form, so arrival order does not
    matter."""
    return gpu_activity_verdict(samples.groupBy(*keys).agg(*gpu_activity_aggregates(order)))


def stream_gpu_runs(
    lines: DataFrame, gap: str = "10 minutes", sample: str = "1 second", late: str = "2 minutes", ts: str = "ts", line: str = "line"
) -> DataFrame:
    """GPU activity of each run of a stream of sample lines, several devices to a sample; append mode.

    Two stateful operators in one stream: the lines of a sample are summed once the watermark has passed the ``sample`` long window that they
    share, and the samples of a run are assessed once it has passed ``gap`` after the last of them. State holds open samples and one row per
    open run. Gives ``run_id, started, ended`` (of the samples' windows) and the columns of ``assess_gpu_activity``.
    """
    window = F.window(ts, sample).alias("_w")
    sampled = parse_gpu_samples(lines.withWatermark(ts, late).select("*", window), ("run_id", "sample_seq", "_w"), line)
    timed = sampled.withColumn("_at", F.window_time("_w"))
    # Spark joins sessions that only touch: a sample just ``gap`` after the last one would still be of the run
    run = timed.groupBy("run_id", F.session_window("_at", f"{gap} -1 microseconds").alias("_s")).agg(
        *gpu_activity_aggregates("sample_seq"), F.min("_w.start").alias("started"), F.max("_w.end").alias("ended")
    )
    return gpu_activity_verdict(run).drop("_s")


def stream_align_events(events: DataFrame, reach: str = "1 second", late: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """Expected events with the video and the audio events of their media within ``reach`` before or after them; append mode.

    ``media_id, expected_seconds`` and the offsets in milliseconds, null where nothing was found: an expected event with no partner gives
    one row once the watermark has passed its reach, one with several gives a row for each pair. Where events of a stream lie more than
    twice the reach apart, and each has its counterparts within it, rows are those of ``avsync.align_events``. Two interval joins on media and
    time; the time condition lets Spark drop events from state as soon as nothing can reach them any more.
    """
    timed = events.withWatermark(ts, late)
    # beside its own events each side keeps the end of the stream, which moves the watermark
    ends = F.col(ts) >= F.lit(END_TIME)

    def side(stream: str) -> DataFrame:
        return timed.where((F.col("stream") == stream) | ends).select(F.col("media_id").alias(f"_{stream}"), F.col(ts).alias(f"{stream}_at"))

    def near(stream: str):
        at, span = F.col(f"{stream}_at"), F.expr(f"INTERVAL {reach}")
        return (F.col("media_id") == F.col(f"_{stream}")) & (at >= F.col("expected_at") - span) & (at <= F.col("expected_at") + span)

    def micros(stream: str):
        return F.unix_micros(f"{stream}_at").alias(f"_{stream}_us")

    expected = side("expected").withColumnRenamed("_expected", "media_id")
    # one column keeps the event time of a joined stream; the partner's becomes a number
    videos = expected.join(side("video"), near("video"), "left_outer").select("media_id", "expected_at", micros("video"))
    joined = videos.join(side("audio"), near("audio"), "left_outer").select("media_id", micros("expected"), "_video_us", micros("audio"))
    offset = lambda a, b: F.round((F.col(f"_{a}_us") - F.col(f"_{b}_us")) / 1000.0, 3).alias
    return joined.select(
        "media_id", (F.col("_expected_us") / 1e6).alias("expected_seconds"),
        offset("video", "expected")("video_offset_ms"), offset("audio", "expected")("audio_offset_ms"), offset("audio", "video")("av_offset_ms"),
    )


def stream_windows(
    samples: DataFrame,
    size: str = "1 minute",
    slide: str | None = None,
    late: str = "2 minutes",
    keys: Sequence[str] = ("job_id",),
    ts: str = "ts",
    **columns: str,
) -> DataFrame:
    """Tumbling or sliding roll-up; samples later than the watermark are dropped."""
    return window_rollup(samples.withWatermark(ts, late), keys, ts, size, slide, **columns)


def stream_sessions(
    samples: DataFrame,
    gap: str = "5 minutes",
    late: str = "2 minutes",
    keys: Sequence[str] = ("job_id",),
    ts: str = "ts",
    fps: str = "rolling_fps",
) -> DataFrame:
    """Session roll-up; a session is emitted in append mode once the watermark passes its end."""
    return (
        samples.withWatermark(ts, late)
        .groupBy(*keys, F.session_window(ts, f"{gap} -1 microseconds").alias("_w"))
        .agg(F.count(F.lit(1)).alias("samples"), F.avg(fps).alias("average_fps"))
        .select(*keys, F.col("_w.start").alias("session_start"), (F.col("_w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("session_end"), "samples", "average_fps")
    )


def stream_dedupe_import(
    files: DataFrame, late: str = "1 day", ts: str = "created_at", content: str = "content", library: str = "library_id"
) -> DataFrame:
    """First arrival of each content per library within the watermark."""
    hashed = files.withColumn("content_hash", content_hash(content)).withWatermark(ts, late)
    return hashed.dropDuplicatesWithinWatermark([library, "content_hash"])


__all__ = [
    "parse_gpu_samples",
    "stream_align_events",
    "stream_dedupe_import",
    "stream_gpu_activity",
    "stream_gpu_runs",
    "stream_sessions",
    "stream_windows",
]
