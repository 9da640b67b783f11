"""Batch and streaming sources. Every reader has an explicit schema and stays lazy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framelane import schemas
from framelane.functions.numeric import STAGES, round_half_even
from framelane.operators import catalog as catalog_operators
from framelane.operators.jobs import resolve_job_state
from framelane.operators.requests import timestamp_millis


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def _json(spark: SparkSession, path, schema: str, **options) -> DataFrame:
    reader = spark.read.schema(schemas.with_corrupt(schema)).option("multiLine", True)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", schemas.CORRUPT)
    return reader.options(**options).json(path)


def _readable(df: DataFrame) -> DataFrame:
    """Drop documents that do not parse; one with a mistyped field keeps its other fields."""
    fields = [c for c in df.columns if c != schemas.CORRUPT]
    parsed = F.exists(F.array(*[F.col(c).isNotNull() for c in fields]), lambda found: found)
    return df.where(F.col(schemas.CORRUPT).isNull() | parsed).drop(schemas.CORRUPT)


def _image_rows(spark: SparkSession, path, pattern: str, role: str, source_id: Column | str | None) -> DataFrame:
    images = spark.read.format("image").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    origin = F.col("image.origin")
    source = F.regexp_extract(origin, r"([^/]+)/[^/]+$", 1)
    if source_id is not None:
        source = F.lit(source_id) if isinstance(source_id, str) else source_id

    @F.arrow_udf("binary")
    def opaque(data: pa.Array, channels: pa.Array) -> pa.Array:
        def three(raw: bytes, n: int) -> bytes:
            return np.frombuffer(raw, np.uint8).reshape(-1, 4)[:, :3].tobytes() if n == 4 and raw else raw

        return pa.array([three(d, n) for d, n in zip(data.to_pylist(), channels.to_pylist())], pa.binary())

    return images.select(
        source.alias("source_id"),
        F.lit(role).alias("role"),
        F.regexp_extract(origin, r"frame_(\d+)\.[^/.]+$", 1).try_cast("int").alias("frame_index"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.when(F.col("image.nChannels") == 4, 3).otherwise(F.col("image.nChannels")).alias("channels"),
        F.col("image.mode").alias("mode"),
        opaque("image.data", "image.nChannels").alias("pixels"),
        origin.alias("origin"),
    )


def read_frames(
    spark: SparkSession,
    path: str | Sequence[str],
    pattern: str = "frame_*.png",
    role: str = "source",
    source_id: Column | str | None = None,
) -> DataFrame:
    """Frame images below ``path``: one row per decodable frame, pixels row-major BGR (transparency is left out).

    The frame number comes from the file name, so the order never depends on listing order. The source is the
    parent folder unless given.
    """
    rows = _image_rows(spark, path, pattern, role, source_id)
    return rows.where((F.col("height") > 0) & F.col("frame_index").isNotNull()).drop("origin")


def frame_rejects(spark: SparkSession, path: str | Sequence[str], pattern: str = "frame_*.png") -> DataFrame:
    """Files that do not decode or carry no frame number."""
    rows = _image_rows(spark, path, pattern, "reject", None)
    reason = F.when(F.col("height") <= 0, F.lit("not decodable")).when(F.col("frame_index").isNull(), F.lit("no frame number"))
    return rows.select("origin", reason.alias("reason")).where(F.col("reason").isNotNull())


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(models, backends) of a model catalog, defaults filled in."""
    raw = _readable(_json(spark, path, schemas.CATALOG))
    models = raw.select(F.explode("models").alias("m")).select("m.*")
    models = models.select(*[F.col(c).alias(snake(c)) for c in models.columns])
    models = models.withColumnRenamed("id", "model_id").withColumns(
        {
            "supports_context_input": F.coalesce("supports_context_input", F.lit(False)),
            "supported_context_kinds": F.coalesce("supported_context_kinds", F.array().cast("array<string>")),
        }
    )
    backends = raw.select(F.explode("backends").alias("b")).select("b.*")
    backends = backends.select(*[F.col(c).alias(snake(c)) for c in backends.columns]).withColumnRenamed("id", "backend_id")
    return catalog_operators.with_defaults(models), backends


def read_benchmark_runs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per (execution path, run) of benchmark JSON files, in the column names of the run operators."""
    raw = _readable(_json(spark, path, schemas.BENCHMARK)).withColumn("file", F.col("_metadata.file_path"))
    fallback = F.coalesce(
        F.greatest(F.lit(1).cast("bigint"), round_half_even(F.col("fixture.durationSeconds") * F.col("fixture.fps"))),
        F.lit(1).cast("bigint"),
    )
    runs = (
        raw.select("file", "modelId", "precision", "tileSize", fallback.alias("fallback_frames"), F.posexplode("results").alias("path_ordinal", "_p"))
        .select("*", F.posexplode("_p.runs").alias("run_ordinal", "_r"))
    )
    peaks = ("processRssBytes", "gpuMemoryUsedBytes", "gpuMemoryTotalBytes", "scratchSizeBytes", "outputSizeBytes")
    return runs.select(
        "file",
        F.col("modelId").alias("model_id"),
        "precision",
        F.col("tileSize").alias("tile_size"),
        F.coalesce("_p.executionPath", F.lit("unknown")).alias("execution_path"),
        "path_ordinal",
        "run_ordinal",
        F.col("_r.repeat").alias("repeat"),
        F.col("_r.status").alias("status"),
        F.col("_r.wallSeconds").alias("wall_seconds"),
        F.col("_r.averageThroughputFps").alias("average_throughput_fps"),
        F.col("_r.segmentCount").alias("segment_count"),
        *[F.col(f"_r.stageTimings.{s}Seconds").alias(f"{s}_seconds") for s in STAGES],
        F.col("_r.stageFrameCounts").alias("stage_frame_counts"),
        F.col("_r.stageEffectiveFps").alias("stage_effective_fps"),
        *[F.col(f"_r.resourcePeaks.{p}").alias(snake(p)) for p in peaks],
        F.col("_r.gpuActivity.maxUtilizationPercent").alias("max_gpu_utilization_percent"),
        F.col("_r.interpolationDiagnostics.sourceFrameCount").alias("diagnostic_source_frames"),
        F.col("_r.sourceMedia.frameCount").alias("media_source_frames"),
        F.col("_r.frameCount").alias("frame_count"),
        F.col("_r.interpolationDiagnostics.outputFrameCount").alias("diagnostic_output_frames"),
        "fallback_frames",
        F.col("_r.error").alias("error"),
    )


def read_fixture_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``name, frame_index, master, degraded`` per entry; a manifest without entries fails the query."""
    raw = _readable(_json(spark, path, schemas.FIXTURE_MANIFEST))
    entries = F.when(F.size("entries") > 0, F.col("entries")).otherwise(
        F.raise_error(F.lit("fixture manifest has no entries"))
    )
    return raw.select("name", F.posexplode(entries).alias("frame_index", "_e")).select("name", "frame_index", "_e.*")


def _progress_columns(prefix: str) -> list[Column]:
    fields = [f.strip().split(" ")[0] for f in schemas.PROGRESS_FIELDS.split(",")]
    skip = {"jobId", "sourcePath", "scratchPath", "outputPath", "scratchSizeBytes", "outputSizeBytes"}
    return [F.col(f"{prefix}{f}").alias(snake(f)) for f in fields if f not in skip]


def read_job_records(spark: SparkSession, path: str, jobs_root: str | None = None) -> DataFrame:
    """Job summaries plus legacy records for progress files of jobs that have none; unreadable files are skipped."""
    summaries = _readable(_json(spark, path, schemas.JOB_SUMMARY, pathGlobFilter="*_summary.json"))
    typed = summaries.where(F.col("jobId").isNotNull()).select(
        F.col("jobId").alias("job_id"),
        F.col("jobKind").alias("job_kind"),
        "label",
        "state",
        F.col("modelId").alias("model_id"),
        F.col("sourcePath").alias("source_path"),
        F.col("scratchPath").alias("scratch_path"),
        F.col("outputPath").alias("output_path"),
        F.coalesce("scratchStats.sizeBytes", "progress.scratchSizeBytes", F.lit(0)).alias("scratch_size_bytes"),
        F.coalesce("outputStats.sizeBytes", "progress.outputSizeBytes", F.lit(0)).alias("output_size_bytes"),
        F.col("updatedAt").alias("updated_at"),
        *_progress_columns("progress."),
    )
    progress = _json(spark, path, schemas.PROGRESS, pathGlobFilter="job_*_progress.json").select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_modification_time").alias("_modified")
    )
    job_id = F.regexp_extract("_file", r"^job_(.+)_progress\.json$", 1)
    conversion = F.startswith("job_id", F.lit("conv_"))
    legacy = (
        progress.withColumn("job_id", job_id)
        .withColumns(
            {
                "state": F.lit(None).cast("string"),
                "phase": F.coalesce("phase", F.lit("queued")),
                "percent": F.coalesce("percent", F.lit(0)),
                "message": F.coalesce("message", F.lit("Job recorded")),
            }
        )
    )
    root = F.lit(jobs_root or path.rstrip("/"))
    legacy = resolve_job_state(legacy).select(
        "job_id",
        F.when(conversion, F.lit("sourceConversion")).otherwise(F.lit("pipeline")).alias("job_kind"),
        F.when(conversion, F.lit("Source Conversion")).otherwise(F.lit("Upscale Job")).alias("label"),
        F.col("resolved_state").alias("state"),
        F.lit(None).cast("string").alias("model_id"),
        F.col("sourcePath").alias("source_path"),
        F.coalesce(
            "scratchPath", F.when(~conversion, F.concat(root, F.lit("/job_"), F.col("job_id")))
        ).alias("scratch_path"),
        F.col("outputPath").alias("output_path"),
        F.coalesce("scratchSizeBytes", F.lit(0)).alias("scratch_size_bytes"),
        F.coalesce("outputSizeBytes", F.lit(0)).alias("output_size_bytes"),
        F.unix_seconds("_modified").cast("string").alias("updated_at"),
        *_progress_columns(""),
    )
    return typed.unionByName(legacy.join(typed.select("job_id").distinct(), "job_id", "left_anti"))


def read_preferences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ratings, picks) of a preferences file; picks keep their order as ``record_order``."""
    raw = _readable(_json(spark, path, schemas.PREFERENCES))
    ratings = raw.select(F.explode("modelRatings").alias("model_id", "_r")).select(
        "model_id", F.col("_r.rating").alias("rating"), F.col("_r.updatedAt").alias("updated_at")
    )
    picks = raw.select(F.posexplode("blindComparisons").alias("record_order", "_p")).select(
        "record_order",
        F.col("_p.sourcePath").alias("source_path"),
        F.col("_p.previewDurationSeconds").alias("duration_seconds"),
        F.col("_p.previewStartOffsetSeconds").alias("start_offset_seconds"),
        F.col("_p.comparisonSignature").alias("signature"),
        F.col("_p.winnerModelId").alias("winner"),
        F.col("_p.candidateModelIds").alias("candidates"),
        timestamp_millis(F.col("_p.createdAt")).cast("bigint").alias("created_ms"),
    )
    return ratings, picks


def file_inventory(spark: SparkSession, roots: Sequence[str], pattern: str = "*") -> DataFrame:
    """``root, path, length, modificationTime`` of every file below the roots; contents are never read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(list(roots))
        .select("path", "length", "modificationTime")
    )
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    root = F.lit(None).cast("string")
    for r in sorted(roots, key=len):
        inside = F.startswith(plain, F.lit("/" + r.split("://")[-1].strip("/") + "/"))
        root = F.when(inside, F.lit(r)).otherwise(root)
    return files.withColumn("root", root)


def stream_progress(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """Stream of progress snapshots: one JSON document per file, every snapshot in a new file."""
    raw = (
        spark.readStream.schema(schemas.PROGRESS)
        .option("multiLine", True)
        .option("maxFilesPerTrigger", max_files)
        .json(path)
    )
    return raw.select(*[F.col(c).alias(snake(c)) for c in raw.columns])


def stream_gpu_samples(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """Stream of raw GPU sample lines (JSON lines ``run_id, sample_seq, ts, line``)."""
    return spark.readStream.schema(schemas.GPU_SAMPLES).option("maxFilesPerTrigger", max_files).json(path)
