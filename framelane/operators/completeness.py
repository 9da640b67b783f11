"""Segment outputs: ordered concatenation, completeness, resume, frame limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from framelane.operators.ordered import blocked_row_number, FRAME_BLOCK, index_block, salted_join

#: Frames that one task compares, about.
FRAMES_PER_TASK = 500_000


def ordered_concat(
    outputs: DataFrame, keys: Sequence[str] = ("source_id",), segment: str = "segment_index", frame: str = "frame_index"
) -> DataFrame:
    """Add ``sequence_index`` (0-based) over all segments of a source in order.

    Segments are the blocks: rows are numbered inside their segment and shifted by the size of the earlier ones.
    """
    numbered = blocked_row_number(outputs, keys, [segment, frame], F.col(segment).cast("bigint"), "_n")
    return numbered.withColumn("sequence_index", F.col("_n") - 1).drop("_n")


def segment_manifest(
    outputs: DataFrame, keys: Sequence[str] = ("source_id",), segment: str = "segment_index"
) -> DataFrame:
    """One row per segment: frames and the sequence index its first frame gets."""
    earlier = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    counts = outputs.groupBy(*keys, segment).agg(F.count(F.lit(1)).alias("frames"))
    return counts.withColumn("first_index", F.coalesce(F.sum("frames").over(earlier), F.lit(0)))


def output_completeness(
    inputs: DataFrame, outputs: DataFrame, keys: Sequence[str] = ("source_id",), frame: str = "frame_index"
) -> DataFrame:
    """Per source: input and output frames, missing and extra ones, and whether the stage is complete and not empty."""
    a = inputs.select(*keys, frame).distinct().withColumn("_i", F.lit(1))
    b = outputs.select(*keys, frame).distinct().withColumn("_o", F.lit(1))
    joined = a.join(b, [*keys, frame], "full_outer")
    missing = F.count_if(F.col("_o").isNull())
    extra = F.count_if(F.col("_i").isNull())
    return (
        joined.groupBy(*keys)
        .agg(
            F.count("_i").alias("input_frames"),
            F.count("_o").alias("output_frames"),
            missing.alias("missing"),
            extra.alias("extra"),
        )
        .withColumn("complete", (F.col("output_frames") > 0) & (F.col("input_frames") == F.col("output_frames")))
    )


def frame_differences(
    inputs: DataFrame, outputs: DataFrame, keys: Sequence[str] = ("source_id",), frame: str = "frame_index"
) -> DataFrame:
    """The missing and the extra frames themselves, with ``problem``; a frame listed more often on one side comes as often as it is over.

    One pass: both sides meet once, in partitions of some ``FRAMES_PER_TASK`` rows, so that no task's table grows with the input.
    """
    a, b = inputs.select(*keys, frame, F.lit(1).alias("_n")), outputs.select(*keys, frame, F.lit(-1).alias("_n"))
    both = a.unionByName(b)
    parts = max(1, -(-both.count() // FRAMES_PER_TASK))
    over = both.repartition(parts, *keys, frame).groupBy(*keys, frame).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    problem = F.when(F.col("_n") > 0, "missing").otherwise("extra")
    repeated = over.withColumn("problem", F.explode(F.array_repeat(problem, F.abs("_n").cast("int"))))
    return repeated.select(*keys, frame, "problem")


def remaining_segments(plans: DataFrame, done: DataFrame, keys: Sequence[str] = ("source_id", "segment_index")) -> DataFrame:
    """Planned segments without a usable checkpoint. ``done`` has ``keys, size_bytes`` and ``seams_ok`` (null = unchecked)."""
    usable = done.where((F.col("size_bytes") > 0) & F.coalesce(F.col("seams_ok"), F.lit(True)))
    return plans.join(usable.select(*keys).distinct(), list(keys), "left_anti")


def limit_frames(
    frames: DataFrame, n: int, keys: Sequence[str] = ("source_id",), order: Sequence[str | Column] = ("frame_index",)
) -> DataFrame:
    """The first ``n`` frames of each source. Spark keeps only ``n`` rows per source before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return frames.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")


def representative_frame(
    frames: DataFrame, keys: Sequence[str] = ("source_id",), order: str = "frame_index", block: int = FRAME_BLOCK
) -> DataFrame:
    """The middle frame of each source (position ``count // 2``, clamped)."""
    counts = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
    placed = blocked_row_number(frames, keys, [order], index_block(order, block), "_n")
    middle = F.least(F.col("_count") - 1, F.floor(F.col("_count") / 2))
    return salted_join(placed, counts, list(keys)).where(F.col("_n") - 1 == middle).drop("_n", "_count")
