"""Batch sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metrics, summaries or manifests as JSON lines."""
    df.write.mode(mode).json(path)


def write_segments(
    frames: DataFrame,
    path: str,
    keys: Sequence[str] = ("source_id",),
    segment: str = "segment_index",
    order: Sequence[str] = ("frame_index",),
) -> None:
    """One Parquet folder per segment, frames in order.

    A segment appears only when its write committed, and only the segments in ``frames`` are replaced, so a resumed run
    keeps the finished ones.
    """
    by = [*keys, segment]
    (
        frames.repartition(*by)
        .sortWithinPartitions(*by, *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )
