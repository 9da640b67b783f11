"""Benchmark-run analytics: stage metrics, summaries, before/after comparison, overhead and throughput."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framelane.functions.numeric import STAGES, first_positive, positive, safe_div
from framelane.operators.ordered import exact_median

SOURCE_STAGES = ("extract", "denoise", "colorize", "upscale")
# Metrics for which a smaller value is the improvement.
LOWER_IS_BETTER = ("wall_seconds", "process_rss_bytes", "scratch_size_bytes")
RUN_METRICS = (
    "wall_seconds",
    "average_throughput_fps",
    "process_rss_bytes",
    "gpu_memory_used_bytes",
    "scratch_size_bytes",
    "max_gpu_utilization_percent",
)


def stage_seconds(events: DataFrame, keys: Sequence[str], stage: str = "stage", seconds: str = "seconds") -> DataFrame:
    """Sum of positive durations per stage as seven ``<stage>_seconds`` columns (0 where none was recorded)."""
    amount = F.when(F.col(seconds) > 0, F.col(seconds).cast("double"))
    return events.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(stage) == s, amount)), F.lit(0.0)).alias(f"{s}_seconds")
            for s in STAGES
        ]
    )


def _frames(stage: str) -> Column:
    source = first_positive("diagnostic_source_frames", "media_source_frames")
    output = first_positive("frame_count", "diagnostic_output_frames")
    return F.coalesce(source if stage in SOURCE_STAGES else output, F.col("fallback_frames")).cast("bigint")


def stage_frame_counts(runs: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """``stage, seconds, frames`` for every stage of a run that took time.

    Source frames count up to upscaling and output frames after it, each with its fallback chain. Runs carry
    ``<stage>_seconds``; the unpivot is a map-side explode.
    """
    entries = F.array(
        *[
            F.struct(F.lit(s).alias("stage"), F.col(f"{s}_seconds").cast("double").alias("seconds"), _frames(s).alias("frames"))
            for s in STAGES
        ]
    )
    return runs.select(*keys, F.explode(F.filter(entries, lambda e: e["seconds"] > 0)).alias("_e")).select(*keys, "_e.*")


def stage_effective_fps(runs: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """:func:`stage_frame_counts` with ``fps`` (frames per second of the stage, rounded to 6)."""
    return stage_frame_counts(runs, keys).withColumn("fps", F.round(safe_div("frames", "seconds"), 6))


def _completed_metrics(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form of the completed runs: ``keys, metric, value``, null values left out."""
    completed = runs.where(F.col("status") == "completed")
    plain = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in RUN_METRICS]
    )
    stages = [f"{s}_seconds" for s in STAGES]
    per_stage = []
    if all(c in runs.columns for c in stages):
        for s in STAGES:
            seconds = positive(F.col(f"{s}_seconds").cast("double"))
            counted = F.when(seconds.isNotNull(), _frames(s))
            fps = F.round(safe_div(counted, seconds), 6)
            per_stage.append(F.struct(F.lit(f"{s}_fps").alias("metric"), fps.alias("value")))
            per_stage.append(F.struct(F.lit(f"{s}_frames").alias("metric"), counted.cast("double").alias("value")))
    entries = F.concat(plain, F.array(*per_stage)) if per_stage else plain
    return (
        completed.select(*keys, F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("_e"))
        .select(*keys, "_e.metric", "_e.value")
    )


def summarize_runs(runs: DataFrame, keys: Sequence[str] = ("execution_path",)) -> DataFrame:
    """Completed runs only: ``metric, runs, median, average`` per key, exact medians, nulls ignored.

    Frame-count medians drop their fraction.
    """
    long = _completed_metrics(runs, keys)
    by = [*keys, "metric"]
    medians = exact_median(
        long, by, "value", extra={"runs": F.count(F.lit(1)), "average": F.round(F.avg("value"), 6)}
    )
    median = F.when(F.endswith("metric", F.lit("_frames")), F.floor("median").cast("double")).otherwise(
        F.round("median", 6)
    )
    return medians.select(*by, "runs", median.alias("median"), "average")


def select_execution_path(
    runs: DataFrame, path: str | None = None, ordinal: str = "path_ordinal", file: str | None = None
) -> DataFrame:
    """Completed runs of the first result, in file order, that has one (and is named ``path`` if given).

    The choice is a scalar subquery; the query fails when there is no such result. With ``file`` (a column) each file has a
    choice of its own, and files without such a result have no rows.
    """
    if file is not None:
        wanted = (F.col("status") == "completed") & (F.lit(True) if path is None else F.col("execution_path") == path)
        first = runs.where(wanted).groupBy(file).agg(F.min(ordinal).alias("_first")).withColumnRenamed(file, "_file")
        return runs.where(wanted).join(first, (F.col(file) == F.col("_file")) & (F.col(ordinal) == F.col("_first")), "left_semi")
    eligible = runs.where(F.col("status") == "completed")
    if path is not None:
        eligible = eligible.where(F.col("execution_path") == path)
    message = "no completed benchmark runs were found" + (f" for execution path {path!r}" if path else "")
    first = F.min(ordinal)
    kind = dict(runs.dtypes)[ordinal]
    chosen = eligible.agg(F.when(first.isNull(), F.raise_error(F.lit(message)).cast(kind)).otherwise(first))
    # the comparison must run for every run, so that a missing choice fails even when no row is left to compare
    picked = runs.where(F.coalesce(F.col(ordinal) == chosen.scalar(), F.lit(False)) & (F.col("status") == "completed"))
    return picked if path is None else picked.where(F.col("execution_path") == path)


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """``metric, before, after, delta, percent_change, improvement_percent`` from two :func:`summarize_runs` results."""
    a = before.select("metric", F.col("median").alias("before"))
    b = after.select("metric", F.col("median").alias("after"))
    delta = F.col("after") - F.col("before")
    percent = safe_div(delta, "before") * 100.0
    better = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -percent).otherwise(percent)
    return a.join(b, "metric", "full_outer").select(
        "metric",
        "before",
        "after",
        F.round(delta, 6).alias("delta"),
        F.round(percent, 4).alias("percent_change"),
        F.round(better, 4).alias("improvement_percent"),
    )


def summarize_repeats(repeats: DataFrame, keys: Sequence[str] = ("model_id", "tile_size")) -> DataFrame:
    """Best and average wall time, average stage times, and rates from the best repeat (0 where it took no time)."""
    best = F.min("wall_seconds")

    def rate(amount: Column) -> Column:
        return F.round(F.when(F.col("_best") > 0, amount / F.col("_best")).otherwise(F.lit(0.0)), 3)

    grouped = repeats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("repeats"),
        best.alias("_best"),
        *[
            F.round(F.avg(c), 4).alias(f"average_{c}")
            for c in ("wall_seconds", "inference_seconds", "batch_load_seconds", "save_seconds")
        ],
        F.max("frame_count").alias("_frames"),
        F.max("width").alias("_width"),
        F.max("height").alias("_height"),
    )
    megapixels = F.col("_frames").cast("double") * F.col("_width") * F.col("_height") / 1_000_000
    return grouped.withColumns(
        {
            "best_wall_seconds": F.round("_best", 4),
            "best_images_per_second": rate(F.col("_frames").cast("double")),
            "best_megapixels_per_second": rate(megapixels),
        }
    ).drop("_best", "_frames", "_width", "_height")


def overhead_summary(samples: DataFrame, name: str = "name", seconds: str = "seconds") -> DataFrame:
    """Min, max, exact median and mean seconds per scenario; the samples themselves stay rows of the input."""
    extra = {
        "samples": F.count(F.lit(1)),
        "min_seconds": F.round(F.min(seconds), 6),
        "max_seconds": F.round(F.max(seconds), 6),
        "average_seconds": F.round(F.avg(seconds), 6),
    }
    return exact_median(samples, [name], seconds, "_median", extra=extra).select(
        name, *extra, F.round("_median", 6).alias("median_seconds")
    )


def launch_overhead(summary: DataFrame, baseline: str, name: str = "name") -> DataFrame:
    """Per scenario: share of the launch baseline in percent and seconds above it."""
    launch = summary.where(F.col(name) == baseline).agg(F.max("median_seconds")).scalar()
    share = F.when(F.col("median_seconds") > 0, F.round(F.col("_launch") / F.col("median_seconds") * 100.0, 2))
    return (
        summary.where(F.col(name) != baseline)
        .withColumn("_launch", launch)
        .select(
            name,
            F.coalesce(share, F.lit(0.0)).alias("launch_share_percent"),
            F.round(F.greatest(F.lit(0.0), F.col("median_seconds") - F.col("_launch")), 6).alias("seconds_minus_launch"),
        )
    )


def overhead_differences(
    summary: DataFrame,
    differences: dict[str, Sequence[tuple[str, float]]],
    name: str = "name",
    floored: Sequence[str] = (),
) -> DataFrame:
    """One row of named sums of medians, e.g. ``{"png_over_decode": [("extractToPng", 1), ("decodeToNull", -1)]}``;
    the names in ``floored`` are at least 0."""

    def value(label: str, terms: Sequence[tuple[str, float]]) -> Column:
        out = None
        for scenario, factor in terms:
            term = F.max(F.when(F.col(name) == scenario, F.col("median_seconds"))) * F.lit(float(factor))
            out = term if out is None else out + term
        return F.round(F.greatest(F.lit(0.0), out) if label in floored else out, 6)

    return summary.agg(*[value(label, terms).alias(label) for label, terms in differences.items()])


def run_throughput(runs: DataFrame) -> DataFrame:
    """Add ``resolved_frames`` (remuxed, else encoded, else total; at least 1) and ``throughput_fps``."""
    frames = F.greatest(
        F.lit(1).cast("bigint"),
        F.coalesce(
            F.nullif(F.col("remuxed_frames"), F.lit(0)), F.nullif(F.col("encoded_frames"), F.lit(0)), F.col("total_frames")
        ).cast("bigint"),
    )
    return runs.withColumn("resolved_frames", frames).withColumn(
        "throughput_fps",
        F.col("resolved_frames") / F.greatest(F.lit(0.001), F.greatest(F.lit(0.0), F.col("elapsed_seconds").cast("double"))),
    )


def denoiser_runs(runs: DataFrame, order: str = "run_order", layout: int = 3) -> tuple[DataFrame, DataFrame]:
    """Per model status and fps, and the layout made of the first successes.

    Returns (results with ``status, frames_per_second``, layout with ``slot, model_id``). The layout query fails when
    fewer than ``layout`` models succeeded.
    """
    ok = F.col("error").isNull()
    fps = F.when(ok & (F.col("seconds") > 0), F.col("frames") / F.col("seconds"))
    results = runs.withColumns(
        {"status": F.when(ok, F.lit("succeeded")).otherwise(F.lit("skipped")), "frames_per_second": fps}
    )
    first = results.where(ok).select("model_id", order).orderBy(order).limit(layout)
    slots = first.agg(F.array_sort(F.collect_list(F.struct(order, "model_id"))).alias("_s"))
    checked = F.when(F.size("_s") == layout, F.col("_s")).otherwise(
        F.raise_error(F.lit(f"fewer than {layout} denoisers succeeded"))
    )
    return results, slots.select(F.posexplode(checked).alias("_i", "_m")).select(
        (F.col("_i") + 1).alias("slot"), F.col("_m.model_id").alias("model_id")
    )
