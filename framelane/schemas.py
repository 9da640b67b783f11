"""Explicit schemas of the JSON inputs. Nothing is inferred; a mistyped number becomes null, an unreadable file is
kept out by the readers."""

from __future__ import annotations

from framelane.functions.numeric import STAGES

CATALOG = """
backends ARRAY<STRUCT<id STRING, label STRING, loader STRING, runtime STRING, supportsGpuSelection BOOLEAN,
  frameTransport STRING>>,
models ARRAY<STRUCT<id STRING, backendId STRING, loader STRING, runtimeModelName STRING, label STRING, summary STRING,
  task STRING, visibleInUi BOOLEAN, comparisonEligible BOOLEAN, executionStatus STRING, supportTier STRING,
  qualityRank INT, supportsContextInput BOOLEAN, supportedContextKinds ARRAY<STRING>, videoNative BOOLEAN,
  mediaSuitability ARRAY<STRING>, nativeScale INT,
  qualityStats STRUCT<analogNoiseScore INT, temporalStabilityScore INT, detailRetentionScore INT, speedClass STRING,
    vramClass STRING, strength STRING, noiseTargets ARRAY<STRING>, knownRisks ARRAY<STRING>>,
  runtimeAsset STRUCT<kind STRING, fileName STRING, downloadUrl STRING>,
  researchRuntime STRUCT<kind STRING, commandEnvVar STRING>,
  specialHandling STRUCT<cropMath STRING, requiresVulkan BOOLEAN, supportsGpuId BOOLEAN,
    prefersFixedScaleModelOutput BOOLEAN, variantSuffixByScale BOOLEAN>>>
"""

_STAGE_SECONDS = ", ".join(f"{s}Seconds DOUBLE" for s in STAGES)

BENCHMARK = f"""
fixture STRUCT<durationSeconds DOUBLE, width INT, height INT, fps DOUBLE>,
modelId STRING, precision STRING, tileSize INT,
results ARRAY<STRUCT<executionPath STRING, runs ARRAY<STRUCT<
  repeat INT, status STRING, executionPath STRING, wallSeconds DOUBLE, averageThroughputFps DOUBLE, segmentCount INT,
  frameCount INT, sourceMedia STRUCT<frameCount INT>,
  interpolationDiagnostics STRUCT<sourceFrameCount INT, outputFrameCount INT>,
  stageTimings STRUCT<{_STAGE_SECONDS}>,
  stageFrameCounts MAP<STRING, INT>, stageEffectiveFps MAP<STRING, DOUBLE>,
  resourcePeaks STRUCT<processRssBytes BIGINT, gpuMemoryUsedBytes BIGINT, gpuMemoryTotalBytes BIGINT,
    scratchSizeBytes BIGINT, outputSizeBytes BIGINT>,
  gpuActivity STRUCT<sampleCount INT, activeSampleCount INT, maxUtilizationPercent INT,
    firstObservedMemoryUsedBytes BIGINT, peakObservedMemoryUsedBytes BIGINT, observedMemoryDeltaBytes BIGINT,
    activityDetected BOOLEAN, warning STRING>,
  error STRING>>>>
"""

FIXTURE_MANIFEST = """
name STRING, frames INT, masterResolution STRUCT<width INT, height INT>,
degradedResolution STRUCT<width INT, height INT>, degradation STRING,
entries ARRAY<STRUCT<master STRING, degraded STRING>>
"""

_COUNTERS = ("extracted", "denoised", "colorized", "upscaled", "interpolated", "encoded", "remuxed")
PROGRESS_FIELDS = (
    "jobId STRING, ts TIMESTAMP, sourcePath STRING, scratchPath STRING, outputPath STRING, phase STRING, percent INT, "
    "message STRING, processedFrames BIGINT, totalFrames BIGINT, "
    + ", ".join(f"{c}Frames BIGINT" for c in _COUNTERS)
    + ", segmentIndex INT, segmentCount INT, segmentProcessedFrames BIGINT, segmentTotalFrames BIGINT, batchIndex INT, "
    "batchCount INT, elapsedSeconds DOUBLE, averageFramesPerSecond DOUBLE, rollingFramesPerSecond DOUBLE, "
    "estimatedRemainingSeconds DOUBLE, processRssBytes BIGINT, gpuMemoryUsedBytes BIGINT, gpuMemoryTotalBytes BIGINT, "
    "scratchSizeBytes BIGINT, outputSizeBytes BIGINT, " + ", ".join(f"{s}StageSeconds DOUBLE" for s in STAGES)
)
PROGRESS = PROGRESS_FIELDS

_STATS = "STRUCT<path STRING, exists BOOLEAN, isDirectory BOOLEAN, sizeBytes BIGINT>"
JOB_SUMMARY = f"""
jobId STRING, jobKind STRING, label STRING, state STRING, sourcePath STRING, modelId STRING, codec STRING,
container STRING, progress STRUCT<{PROGRESS_FIELDS}>, recordedCount INT, scratchPath STRING, scratchStats {_STATS},
outputPath STRING, outputStats {_STATS}, updatedAt STRING
"""

PREFERENCES = """
modelRatings MAP<STRING, STRUCT<rating INT, updatedAt STRING>>,
blindComparisons ARRAY<STRUCT<sourcePath STRING, previewDurationSeconds DOUBLE, previewStartOffsetSeconds DOUBLE,
  comparisonSignature STRING, winnerModelId STRING, candidateModelIds ARRAY<STRING>, createdAt STRING>>
"""

GPU_SAMPLES = "run_id STRING, sample_seq BIGINT, ts TIMESTAMP, line STRING"
CORRUPT = "_corrupt_record"


def with_corrupt(schema: str) -> str:
    return f"{schema.strip()}, {CORRUPT} STRING"
