"""Temporal planning: segments, halos, temporal chunks, frame assignment, sampling and timeline resampling.

Planning tables are one row per source or segment; frame tables are joined on ``(source, segment)`` or
``(source, frame)`` equality only, so no plan degenerates into a range join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framelane.functions.numeric import as_column, round_half_even, safe_div

SEGMENT_MIN_FRAMES = 48
SEGMENT_SECONDS = 10.0
TEMPORAL_RADIUS = 2
TEMPORAL_MIN_FRAMES = 5


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def event_times(df: DataFrame, duration: str = "duration_seconds", interval: str = "interval_seconds") -> DataFrame:
    """One row per expected event: ``event_index, event_seconds``; none if duration or interval is not positive."""
    d, step = F.col(duration).cast("double"), F.col(interval).cast("double")
    count = F.floor(safe_div(d, step))
    index = F.when((d > 0) & (step > 0), F.sequence(_long(0), count.cast("bigint")))
    return (
        df.withColumn("event_index", F.explode(index))
        .withColumn("event_seconds", F.round(F.col("event_index") * step, 6))
        .where(F.col("event_seconds") < d)
    )


def segment_frames(frames: Column, fps: Column, seconds: float | None = SEGMENT_SECONDS, single: bool = False) -> Column:
    """Length of a full segment of a source."""
    if single:
        return frames
    wanted = seconds if seconds is not None and seconds > 0 else SEGMENT_SECONDS
    limit = F.greatest(_long(SEGMENT_MIN_FRAMES), round_half_even(fps * F.lit(wanted)))
    return F.greatest(_long(1), F.least(limit, frames))


def plan_segments(
    sources: DataFrame,
    keys: Sequence[str] = ("source_id",),
    frames: str = "frame_count",
    fps: str = "frame_rate",
    seconds: float | None = SEGMENT_SECONDS,
    single: bool = False,
) -> DataFrame:
    """One row per segment. Each row also carries ``segment_frames, segment_count, total_frames`` of its source, so
    that halo planning needs no window over the source."""
    n = F.col(frames).cast("bigint")
    rate = F.when(F.col(fps) > 0, F.col(fps).cast("double")).otherwise(F.lit(1.0))
    planned = (
        sources.where(n > 0)
        .select(*keys, n.alias("total_frames"), rate.alias("_fps"))
        .withColumn("segment_frames", segment_frames(F.col("total_frames"), F.col("_fps"), seconds, single))
        .withColumn("segment_count", F.ceil(F.col("total_frames") / F.col("segment_frames")).cast("bigint"))
        .withColumn("segment_index", F.explode(F.sequence(_long(0), F.col("segment_count") - 1)))
    )
    start = F.col("segment_index") * F.col("segment_frames")
    return (
        planned.withColumn("start_frame", start)
        .withColumn("frame_count", F.least(F.col("segment_frames"), F.col("total_frames") - F.col("start_frame")))
        .withColumns(
            {
                "start_seconds": F.col("start_frame") / F.col("_fps"),
                "duration_seconds": F.col("frame_count") / F.col("_fps"),
            }
        )
        .drop("_fps")
    )


def output_frame_count(start, count, source_fps, output_fps) -> Column:
    """Frames a segment yields after frame-rate conversion (never fewer than it has)."""
    first, frames = as_column(start), as_column(count)
    src, out = as_column(source_fps).cast("double"), as_column(output_fps).cast("double")
    begin = round_half_even(safe_div(first * out, src))
    end = round_half_even(safe_div((first + frames) * out, src))
    return F.when(frames <= 0, _long(0)).otherwise(F.greatest(frames.cast("bigint"), end - begin))


def skip_interpolation(input_frames, target_frames) -> Column:
    return as_column(target_frames) <= as_column(input_frames)


def _ratio_start(segment_start: Column, expanded_start: Column, src: Column, out: Column) -> Column:
    ratio = safe_div(out, src)
    shift = round_half_even(segment_start * ratio) - round_half_even(expanded_start * ratio)
    return F.greatest(_long(0), shift)


def plan_halos(segments: DataFrame, source_fps: str, output_fps: str, halo: int = 1) -> DataFrame:
    """Expand every segment by its neighbours' edge frames; a projection of :func:`plan_segments`."""
    src, out = F.col(source_fps).cast("double"), F.col(output_fps).cast("double")
    before = F.when(F.col("segment_index") > 0, _long(halo)).otherwise(_long(0))
    after = F.when(F.col("segment_index") < F.col("segment_count") - 1, _long(halo)).otherwise(_long(0))
    end = F.col("start_frame") + F.col("frame_count")
    return (
        segments.withColumn("expanded_start", F.greatest(_long(0), F.col("start_frame") - before))
        .withColumn("_end", F.least(F.col("total_frames"), end + after))
        .withColumn("expanded_count", F.greatest(_long(1), F.col("_end") - F.col("expanded_start")))
        .withColumns(
            {
                "overlap_before": F.col("start_frame") - F.col("expanded_start"),
                "overlap_after": F.greatest(_long(0), F.col("_end") - end),
                "output_start": _ratio_start(F.col("start_frame"), F.col("expanded_start"), src, out),
                "output_count": output_frame_count("start_frame", "frame_count", src, out),
                "expanded_output_count": output_frame_count("expanded_start", "expanded_count", src, out),
                "expanded_start_seconds": F.coalesce(safe_div("expanded_start", src), F.lit(0.0)),
                "expanded_seconds": F.coalesce(safe_div("expanded_count", src), F.lit(0.0)),
            }
        )
        .drop("_end")
    )


def shrink_last_segment(
    plans: DataFrame,
    actual: DataFrame,
    source_fps: str,
    output_fps: str,
    keys: Sequence[str] = ("source_id",),
) -> tuple[DataFrame, DataFrame]:
    """Fit the last plan of a source to the frames really read.

    ``actual`` has ``(keys, segment_index, actual_count)``. Only the last plan may be short, and only by less than its
    own frames. Returns (accepted plans, rejected plans with ``error``).
    """
    src, out = F.col(source_fps).cast("double"), F.col(output_fps).cast("double")
    read = F.col("actual_count")
    last = F.col("segment_index") == F.col("segment_count") - 1
    same = read == F.col("expanded_count")
    short = F.coalesce((read < F.col("expanded_count")) & last & (read > F.col("overlap_before")), F.lit(False))
    # plans are exploded from few sources, which Spark's size estimates do not see: it would broadcast all of them
    joined = plans.join(actual.hint("merge"), [*keys, "segment_index"], "left").withColumn(
        "_ok", F.coalesce(same, F.lit(False)) | short
    )
    rejected = joined.where(~F.col("_ok")).select(
        *keys,
        "segment_index",
        F.concat(
            F.lit("expected "),
            F.col("expanded_count").cast("string"),
            F.lit(" frames, read "),
            F.coalesce(read.cast("string"), F.lit("none")),
        ).alias("error"),
    )
    fitted = joined.where("_ok").withColumn("_short", short)
    frames = F.greatest(_long(1), read - F.col("overlap_before"))
    changes = {
        "frame_count": frames,
        "expanded_output_count": output_frame_count("expanded_start", "actual_count", src, out),
        "output_count": output_frame_count(F.col("start_frame"), frames, src, out),
        "expanded_seconds": F.coalesce(safe_div(read, src), F.lit(0.0)),
        "overlap_before": F.least(F.col("overlap_before"), F.greatest(_long(0), read - 1)),
        "overlap_after": _long(0),
        "expanded_count": read,
    }
    accepted = fitted.select(
        *[
            F.when(F.col("_short"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
            for c in plans.columns
        ]
    )
    return accepted, rejected


def plan_temporal_chunks(
    sources: DataFrame,
    keys: Sequence[str] = ("source_id",),
    frames: str = "frame_count",
    chunk: int = 32,
    radius: int = TEMPORAL_RADIUS,
    minimum: int = TEMPORAL_MIN_FRAMES,
) -> DataFrame:
    """Chunks with a halo of ``radius`` frames, where to trim the result, and how many repeats of the last frame pad
    the input up to ``minimum``."""
    n = F.col(frames).cast("bigint")
    step = max(1, chunk)
    planned = (
        sources.where(n > 0)
        .select(*keys, n.alias("_n"))
        .withColumn("chunk_start", F.explode(F.sequence(_long(0), F.col("_n") - 1, _long(step))))
    )
    end = F.least(F.col("_n"), F.col("chunk_start") + step)
    expanded_start = F.greatest(_long(0), F.col("chunk_start") - radius)
    expanded_end = F.least(F.col("_n"), F.col("chunk_end") + radius)
    return (
        planned.withColumn("chunk_end", end)
        .withColumns(
            {
                "chunk_index": F.floor(F.col("chunk_start") / step).cast("bigint"),
                "expanded_start": expanded_start,
                "expanded_end": expanded_end,
            }
        )
        .withColumns(
            {
                "trim_start": F.col("chunk_start") - F.col("expanded_start"),
                "trim_end": F.col("chunk_end") - F.col("expanded_start"),
                "pad_frames": F.greatest(_long(0), F.lit(minimum) - (F.col("expanded_end") - F.col("expanded_start"))),
            }
        )
        .drop("_n")
    )


def assign_frames_to_segments(
    frames: DataFrame, step: str | int, halo: int = 0, frame_index: str = "frame_index", segment_count: str | None = None
) -> DataFrame:
    """Add ``segment_index`` and ``is_core``; a frame near an edge is repeated for each segment whose halo covers it.

    ``step`` is the full segment length (column or number). The candidates come from integer division, so the plan is a
    map-side explode and later joins stay equi-joins on ``(source, segment_index)``. Without ``segment_count`` the
    last frame may name a following segment that does not exist; an inner join with the plans removes it.
    """
    i, size = F.col(frame_index).cast("bigint"), as_column(step)
    low = F.greatest(_long(0), F.floor((i - halo) / size).cast("bigint"))
    high = F.floor((i + halo) / size).cast("bigint")
    if segment_count is not None:
        high = F.least(high, F.col(segment_count) - 1)
    return frames.withColumn("segment_index", F.explode(F.sequence(low, high))).withColumn(
        "is_core", F.col("segment_index") == F.floor(i / size).cast("bigint")
    )


def sample_frames(
    frames: DataFrame,
    fps: float,
    start: float,
    duration: float,
    keys: Sequence[str] = ("source_id",),
    seconds: str = "frame_seconds",
    order: Sequence[str] = ("frame_index",),
) -> DataFrame:
    """First frame of every 1/fps interval inside ``[start, start + duration)``."""
    t = F.col(seconds).cast("double")
    others = [c for c in frames.columns if c not in keys]
    inside = frames.where((t >= start) & (t < start + duration)).withColumn(
        "sample_index", F.floor((t - start) * fps).cast("bigint")
    )
    return (
        inside.groupBy(*keys, "sample_index")
        .agg(F.min_by(F.struct(*others), F.struct(seconds, *order)).alias("_first"))
        .select(*keys, "sample_index", *[F.col(f"_first.{c}").alias(c) for c in others])
    )


def resample_timeline(
    frames: DataFrame,
    source_fps: Column | float,
    output_fps: Column | float,
    how: str = "linear",
    keys: Sequence[str] = ("source_id",),
    frame_index: str = "frame_index",
    values: str | None = None,
) -> DataFrame:
    """Output frames of a frame-rate conversion: ``output_index, left_index, right_index, weight``.

    Every source frame emits the outputs that fall between it and its successor, so the only join is one equi-join on
    ``(keys, frame_index + 1)``. A frame without successor is the last one and fixes the total. When the target is not
    faster than the source the frames pass through. With ``values`` (an array column) the blended array is added.
    """
    src, out = as_column(source_fps).cast("double"), as_column(output_fps).cast("double")
    i = F.col(frame_index).cast("bigint")
    carried = [values] if values else []
    base = frames.select(*keys, i.alias("left_index"), src.alias("_src"), out.alias("_out"), *carried)
    follow = base.select(
        *keys,
        (F.col("left_index") - 1).alias("left_index"),
        F.lit(True).alias("_has_next"),
        *([F.col(values).alias("_next")] if values else []),
    )
    joined = base.join(follow, [*keys, "left_index"], "left").withColumn(
        "_has_next", F.coalesce(F.col("_has_next"), F.lit(False))
    )
    left = F.col("left_index")
    passing = F.col("_out") <= F.col("_src")
    # one extra candidate on both sides, then the exact floor test: no reliance on rounding of the bounds
    first = F.greatest(_long(0), F.floor(left * F.col("_out") / F.col("_src")).cast("bigint") - 1)
    last = F.ceil((left + 1) * F.col("_out") / F.col("_src")).cast("bigint") + 1
    total = round_half_even((left + 1) * F.col("_out") / F.col("_src"))
    candidates = F.when(passing, F.array(left)).otherwise(F.sequence(first, last))
    position = F.col("output_index") * F.col("_src") / F.col("_out")
    hit = passing | (
        (F.floor(position).cast("bigint") == left) & (F.col("_has_next") | (F.col("output_index") < total))
    )
    placed = joined.withColumn("output_index", F.explode(candidates)).where(hit)
    exact = F.when(passing, F.lit(0.0)).otherwise(position - left)
    weight = F.lit(0.0) if how == "duplicate" else F.when(F.col("_has_next"), exact).otherwise(F.lit(0.0))
    right = left if how == "duplicate" else F.when(F.col("_has_next"), left + 1).otherwise(left)
    result = [*keys, "output_index", "left_index", right.alias("right_index"), weight.alias("weight")]
    if values:
        blend = F.zip_with(
            F.col(values), F.coalesce(F.col("_next"), F.col(values)), lambda a, b: a + (b - a) * F.col("_weight")
        )
        placed = placed.withColumn("_weight", weight)
        result.append((F.col(values) if how == "duplicate" else blend).alias(values))
    return placed.select(*result)
