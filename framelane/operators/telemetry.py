"""Progress and GPU telemetry: parsing, activity, peaks, throughput, percent and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framelane.functions.numeric import as_column, round_half_even, safe_div
from framelane.operators.ordered import blocked_lag, blocked_running, salted_join, time_block

MIB = 1024 * 1024
ACTIVE_PERCENT = 5
ACTIVE_MEMORY_DELTA = 256 * MIB
IDLE_WARNING = "the GPU stayed idle: neither utilisation nor memory growth reached the threshold"
LATER_STAGES = ("upscaled_frames", "interpolated_frames", "encoded_frames", "remuxed_frames")


def _number(text: Column) -> Column:
    """Truncated integer of a decimal text, null where it does not parse."""
    value = F.trim(text).try_cast("double")
    return F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("bigint")


def parse_gpu_samples(lines: DataFrame, keys: Sequence[str] = ("run_id", "sample_seq"), line: str = "line") -> DataFrame:
    """Lines ``utilization, used MiB, total MiB`` of one sample → highest utilization and summed bytes.

    A line is read from the left and stops counting at its first bad field. The three values are null when no line
    gives a utilization or none gives a total.
    """
    parts = F.split(F.trim(line), ",", 3)
    shaped = F.size(parts) == 3
    utilization = F.when(shaped, _number(F.get(parts, 0)))
    used = F.when(utilization.isNotNull(), _number(F.get(parts, 1)))
    total = F.when(used.isNotNull(), _number(F.get(parts, 2)))
    parsed = lines.select(*keys, utilization.alias("_u"), used.alias("_m"), total.alias("_t"))
    usable = F.col("_u").isNotNull() & F.col("_t").isNotNull()
    return (
        parsed.groupBy(*keys)
        .agg(F.max("_u").alias("_u"), F.sum("_m").alias("_m"), F.sum("_t").alias("_t"))
        .select(
            *keys,
            F.when(usable, F.col("_u")).alias("utilization_percent"),
            F.when(usable, F.col("_m") * MIB).alias("memory_used_bytes"),
            F.when(usable, F.col("_t") * MIB).alias("memory_total_bytes"),
        )
    )


def gpu_memory_totals(devices: DataFrame, keys: Sequence[str] = ("run_id", "sample_seq")) -> DataFrame:
    """Used and total bytes over all devices of a sample; null when the total is not positive."""
    total = F.sum("memory_total_mib")
    return (
        devices.groupBy(*keys)
        .agg(F.sum("memory_used_mib").alias("_used"), total.alias("_total"))
        .select(
            *keys,
            F.when(F.col("_total") > 0, F.col("_used") * MIB).alias("gpu_memory_used_bytes"),
            F.when(F.col("_total") > 0, F.col("_total") * MIB).alias("gpu_memory_total_bytes"),
        )
    )


def gpu_activity_aggregates(order: str) -> list[Column]:
    """The mergeable aggregates behind :func:`assess_gpu_activity`, shared with the streaming form."""
    seen = F.col("utilization_percent").isNotNull()
    memory = F.when(seen, F.col("memory_used_bytes"))
    return [
        F.count("utilization_percent").alias("sample_count"),
        F.count_if(F.col("utilization_percent") >= ACTIVE_PERCENT).alias("active_sample_count"),
        F.max("utilization_percent").alias("max_utilization_percent"),
        F.min_by(memory, F.when(memory.isNotNull(), F.col(order))).alias("first_memory_bytes"),
        F.max(memory).alias("peak_memory_bytes"),
    ]


def gpu_activity_verdict(df: DataFrame) -> DataFrame:
    delta = F.greatest(F.lit(0).cast("bigint"), F.col("peak_memory_bytes") - F.col("first_memory_bytes"))
    detected = F.coalesce(F.col("max_utilization_percent") >= ACTIVE_PERCENT, F.lit(False)) | F.coalesce(
        F.col("memory_delta_bytes") >= ACTIVE_MEMORY_DELTA, F.lit(False)
    )
    return (
        df.withColumn("memory_delta_bytes", delta)
        .withColumn("activity_detected", detected)
        .withColumn("warning", F.when((F.col("sample_count") > 0) & ~F.col("activity_detected"), F.lit(IDLE_WARNING)))
    )


def assess_gpu_activity(samples: DataFrame, keys: Sequence[str] = ("run_id",), order: str = "sample_seq") -> DataFrame:
    """Whether a run used the GPU: busy samples or at least 256 MiB of memory growth."""
    return gpu_activity_verdict(samples.groupBy(*keys).agg(*gpu_activity_aggregates(order)))


def resource_peaks(progress: DataFrame, keys: Sequence[str] = ("job_id",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Peak RSS, GPU memory, scratch and output sizes, and the last GPU total, per job."""
    total = F.col("gpu_memory_total_bytes")
    return progress.groupBy(*keys).agg(
        F.max("process_rss_bytes").alias("process_rss_bytes"),
        F.max("gpu_memory_used_bytes").alias("gpu_memory_used_bytes"),
        F.max_by(total, F.struct(*order)).alias("gpu_memory_total_bytes"),
        F.coalesce(F.max("scratch_size_bytes"), F.lit(0)).alias("scratch_size_bytes"),
        F.coalesce(F.max("output_size_bytes"), F.lit(0)).alias("output_size_bytes"),
    )


def throughput(
    progress: DataFrame,
    keys: Sequence[str] = ("job_id",),
    ts: str = "ts",
    order: Sequence[str] = ("ts",),
    processed: str = "processed_frames",
    total: str = "total_frames",
    min_gap: float = 1.0,
    block_seconds: int = 3_600,
) -> DataFrame:
    """Add ``elapsed_seconds, average_fps, rolling_fps, remaining_seconds``.

    Elapsed time counts from the job's first snapshot. The rolling rate compares with the snapshot before and is null
    for gaps under ``min_gap``; the streaming form keeps the last sampled snapshot instead.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    timed = progress.withColumn("_s", seconds)
    started = timed.groupBy(*keys).agg(F.min("_s").alias("_start"))
    lagged = blocked_lag(timed, keys, list(order), time_block(ts, block_seconds), {"_before": "_s", "_frames": processed})
    stepped = salted_join(lagged, started, list(keys), "left")
    gap = F.col("_s") - F.col("_before")
    elapsed = F.col("_s") - F.col("_start")
    average = F.when((F.col("elapsed_seconds") > 0) & (F.col(processed) > 0), F.col(processed) / F.col("elapsed_seconds"))
    moved = F.greatest(F.lit(0).cast("bigint"), F.col(processed) - F.col("_frames"))
    return (
        stepped.withColumn("elapsed_seconds", elapsed)
        .withColumns({"average_fps": average, "rolling_fps": F.when(gap >= min_gap, moved / gap)})
        .withColumn(
            "remaining_seconds",
            F.when(F.col(total) > F.col(processed), safe_div(F.col(total) - F.col(processed), F.col("average_fps"))),
        )
        .drop("_s", "_before", "_frames", "_start")
    )


def gate_extracting(progress: DataFrame) -> DataFrame:
    """Drop ``extracting`` snapshots once a later stage has counted frames (works on streams too)."""
    later = F.lit(False)
    for c in LATER_STAGES:
        later = later | (F.coalesce(F.col(c), F.lit(0)) > 0)
    return progress.where((F.col("phase") != "extracting") | ~later)


SIGNATURE = ("phase", "percent", "processed_frames", "message")


def dedupe_progress(
    progress: DataFrame,
    keys: Sequence[str] = ("job_id",),
    ts: str = "ts",
    order: Sequence[str] = ("ts",),
    signature: Sequence[str] = SIGNATURE,
    block_seconds: int = 3_600,
) -> DataFrame:
    """Snapshots whose signature differs from the snapshot before (the first one always stays)."""
    stepped = blocked_lag(
        progress.withColumn("_signature", F.struct(*signature)),
        keys,
        list(order),
        time_block(ts, block_seconds),
        {"_before": "_signature"},
    )
    return stepped.where(~F.col("_signature").eqNullSafe(F.col("_before"))).drop("_signature", "_before")


def _scaled(frames: Column, source_total: Column, total: Column) -> Column:
    """Source-frame counter on the output scale."""
    scaled = F.greatest(F.lit(0).cast("bigint"), round_half_even(safe_div(frames, source_total) * total))
    return F.when(source_total > 0, F.least(total, scaled)).otherwise(F.lit(0).cast("bigint"))


def progress_percent(
    progress: DataFrame,
    interpolation_mode: Column | str = "interpolation_mode",
    denoise_mode: Column | str = "denoise_mode",
    colorization_mode: Column | str = "colorization_mode",
) -> DataFrame:
    """Add ``percent`` (0..99) and ``processed_frames`` from the stage counters and the run's modes.

    Weights: extract 10, encode 15, remux 5; the other 70 go to the enabled stages.
    """
    mode, denoise, color = (
        F.col(c) if isinstance(c, str) else c for c in (interpolation_mode, denoise_mode, colorization_mode)
    )
    total = F.col("total_frames").cast("bigint")
    source = F.when(F.col("source_total_frames") > 0, F.col("source_total_frames").cast("bigint")).otherwise(total)
    denoise_weight = F.when(denoise != "off", 10).otherwise(0)
    only_motion, only_color, after = mode == "interpolateOnly", color == "colorizeOnly", mode == "afterUpscale"
    before = color == "beforeUpscale"
    weights = {
        "extracted_frames": F.lit(10),
        "denoised_frames": denoise_weight,
        "colorized_frames": F.when(only_motion, 0)
        .when(only_color, 70 - denoise_weight)
        .when(after, F.when(before, 15).otherwise(0))
        .otherwise(F.when(before, 20).otherwise(0)),
        "upscaled_frames": F.when(only_motion | only_color, 0)
        .when(after, F.when(before, 20).otherwise(35) - denoise_weight)
        .otherwise(F.when(before, 50).otherwise(70) - denoise_weight),
        "interpolated_frames": F.when(only_motion, 70 - denoise_weight)
        .when(only_color, 0)
        .when(after, 35)
        .otherwise(0),
        "encoded_frames": F.lit(15),
        "remuxed_frames": F.lit(5),
    }
    source_side = ("extracted_frames", "denoised_frames", "colorized_frames", "upscaled_frames")

    def counter(name: str) -> Column:
        raw = F.coalesce(F.col(name), F.lit(0)).cast("bigint")
        return F.when(mode == "off", raw).otherwise(_scaled(raw, source, total)) if name in source_side else raw

    # counters and weights get columns of their own, so that neither is written out twice in the final expressions
    staged = progress.withColumns(
        {
            **{f"_c_{n}": counter(n) for n in weights},
            **{f"_w_{n}": F.greatest(F.lit(0), w) for n, w in weights.items()},
        }
    )
    score = F.lit(0.0)
    for name in weights:
        ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), safe_div(f"_c_{name}", total)))
        score = score + F.when(total > 0, ratio).otherwise(0.0) * F.col(f"_w_{name}")
    return staged.withColumns(
        {
            "percent": F.least(F.lit(99).cast("bigint"), round_half_even(score)),
            "processed_frames": F.greatest(*[F.col(f"_c_{n}") for n in weights]),
        }
    ).drop(*[f"_{kind}_{n}" for kind in "cw" for n in weights])


def window_rollup(
    samples: DataFrame,
    keys: Sequence[str] = ("job_id",),
    ts: str = "ts",
    size: str = "1 minute",
    slide: str | None = None,
    fps: str = "rolling_fps",
    memory: str = "gpu_memory_used_bytes",
) -> DataFrame:
    """Tumbling or sliding roll-up: samples, mean fps and peak memory per window (batch or stream)."""
    return (
        samples.groupBy(*keys, F.window(F.col(ts), size, slide).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("samples"), F.avg(fps).alias("average_fps"), F.max(memory).alias("peak_memory")
        )
        .select(
            *keys,
            F.unix_seconds(F.col("_w.start").cast("timestamp")).alias("window_start"),
            F.unix_seconds(F.col("_w.end").cast("timestamp")).alias("window_end"),
            "samples",
            "average_fps",
            "peak_memory",
        )
    )


def session_rollup(
    samples: DataFrame,
    gap_seconds: float,
    keys: Sequence[str] = ("job_id",),
    ts: str = "ts",
    order: Sequence[str] = ("ts",),
    fps: str = "rolling_fps",
    block_seconds: int = 3_600,
) -> DataFrame:
    """Sessions of a job, split where the next sample comes ``gap_seconds`` or more later.

    ``session_window`` would sort a whole job in one task; here the gap test and the running session number work on
    time blocks and only per-session facts are shuffled. Use ``session_window`` for the streaming form.
    """
    timed = samples.withColumn("_s", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    block = time_block(ts, block_seconds)
    stepped = blocked_lag(timed, keys, list(order), block, {"_before": "_s"})
    opened = stepped.withColumn(
        "_opens", F.coalesce(F.col("_s") - F.col("_before") >= gap_seconds, F.lit(True)).cast("int")
    )
    numbered = blocked_running(opened, keys, list(order), block, sums={"session_index": "_opens"})
    return numbered.groupBy(*keys, "session_index").agg(
        F.min("_s").alias("start_seconds"),
        F.max("_s").alias("end_seconds"),
        F.count(F.lit(1)).alias("samples"),
        F.avg(fps).alias("average_fps"),
    )


def rising_edges(
    signal: DataFrame,
    threshold: Column | float,
    keys: Sequence[str] = ("media_id",),
    order: Sequence[str] = ("frame_index",),
    value: str = "mean_luma",
    block: Column | None = None,
) -> DataFrame:
    """Rows at or above the threshold whose predecessor was not; a first row above it counts."""
    from framelane.operators.ordered import index_block

    active = F.coalesce(F.col(value) >= as_column(threshold), F.lit(False))
    stepped = blocked_lag(
        signal.withColumn("_active", active),
        keys,
        list(order),
        block if block is not None else index_block(order[0]),
        {"_was_active": "_active"},
    )
    return stepped.where(F.col("_active") & ~F.coalesce(F.col("_was_active"), F.lit(False))).drop("_active", "_was_active")
