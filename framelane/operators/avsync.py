"""Audio/video event synchronisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framelane.operators.ordered import blocked_row_number

TOLERANCE_MS = 45.0
WINDOW_MS = 5.0
STREAMS = ("expected", "video", "audio")


def audio_levels(
    samples: DataFrame,
    sample_rate: int,
    window_ms: float = WINDOW_MS,
    keys: Sequence[str] = ("media_id",),
    index: str = "sample_index",
    sample: str = "sample",
) -> DataFrame:
    """Loudest sample per fixed window: ``window_index, window_seconds, level``; an incomplete last window is dropped.

    Samples are widened before taking the absolute value (the most negative 16-bit sample has no 16-bit opposite).
    """
    size = max(1, int(sample_rate * (window_ms / 1000.0)))
    return (
        samples.groupBy(*keys, F.floor(F.col(index) / size).cast("bigint").alias("window_index"))
        .agg(F.max(F.abs(F.col(sample).cast("int"))).alias("level"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == size)
        .select(*keys, "window_index", (F.col("window_index") * size / F.lit(sample_rate)).alias("window_seconds"), "level")
    )


def align_events(
    events: DataFrame,
    keys: Sequence[str] = ("media_id",),
    stream: str = "stream",
    seconds: str = "seconds",
    order: Sequence[str] = ("seconds",),
    block: Column | None = None,
) -> DataFrame:
    """k-th expected with k-th video with k-th audio event, as far as the shortest list goes.

    Numbering is per stream, so index k exists in all three exactly when k is below the shortest length; one grouped
    aggregate on ``(keys, k)`` does the alignment without joins.
    """
    spread = block if block is not None else F.floor(F.col(seconds) / 3600).cast("bigint")
    numbered = blocked_row_number(events, [*keys, stream], list(order), spread, "_k")
    grouped = numbered.groupBy(*keys, (F.col("_k") - 1).alias("event_index")).agg(
        *[F.max(F.when(F.col(stream) == s, F.col(seconds))).alias(f"{s}_seconds") for s in STREAMS]
    )
    complete = F.lit(True)
    for s in STREAMS:
        complete = complete & F.col(f"{s}_seconds").isNotNull()

    def offset(a: str, b: str) -> Column:
        return F.round((F.col(f"{a}_seconds") - F.col(f"{b}_seconds")) * 1000.0, 3)

    return grouped.where(complete).withColumns(
        {
            "video_offset_ms": offset("video", "expected"),
            "audio_offset_ms": offset("audio", "expected"),
            "av_offset_ms": offset("audio", "video"),
        }
    )


def av_sync_report(
    aligned: DataFrame, keys: Sequence[str] = ("media_id",), tolerance_ms: float = TOLERANCE_MS
) -> DataFrame:
    """Largest offsets per media and whether audio and video stay within the tolerance.

    Media without any aligned event give no row; see :func:`unmatched_media`.
    """
    names = ("video", "audio", "av")
    out = aligned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("compared_events"),
        *[F.round(F.max(F.abs(f"{n}_offset_ms")), 3).alias(f"max_{n}_offset_ms") for n in names],
    )
    return out.withColumn("passed", F.col("max_av_offset_ms") <= tolerance_ms)


def unmatched_media(events: DataFrame, report: DataFrame, keys: Sequence[str] = ("media_id",)) -> DataFrame:
    """Media for which no event could be compared (an error in a validation run)."""
    return events.select(*keys).distinct().join(report, list(keys), "left_anti")
