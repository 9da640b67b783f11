"""Request records: keys, identities, normalisation, validation and candidate sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framelane.functions.text import file_stem, normalized_path, sanitize_name, sha_prefix, slashed

INTERPOLATION_MODES = ("off", "afterUpscale", "interpolateOnly")
INTERPOLATION_FPS = (30, 60)
PRECISIONS = ("fp32", "fp16", "bf16")


def request_key(df: DataFrame, columns: Sequence[str], length: int = 12, name: str = "request_key") -> DataFrame:
    """Stable key of the normalised settings: fields joined by ``|``, floats with four decimals, flags as 0/1, null
    numbers as 0 (``gpu_id`` as -1) and null text as nothing."""
    types = dict(df.dtypes)

    def text(c: str) -> Column:
        kind = types[c]
        if kind in ("double", "float"):
            return F.format_string("%.4f", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        if kind == "boolean":
            return F.coalesce(F.col(c), F.lit(False)).cast("int").cast("string")
        if kind in ("int", "bigint", "smallint", "tinyint"):
            return F.coalesce(F.col(c), F.lit(-1 if c == "gpu_id" else 0)).cast("string")
        if kind.startswith("array"):
            return F.array_join(F.coalesce(F.col(c), F.array().cast(kind)), "|")
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return df.withColumn(name, sha_prefix(F.concat_ws("|", *[text(c) for c in columns]), length))


def source_identity(df: DataFrame, path: str = "source_path") -> DataFrame:
    """Add ``source_key, fingerprint, library_id``."""
    stem = sanitize_name(file_stem(path), "source")
    return (
        df.withColumn("source_key", normalized_path(path))
        .withColumn("fingerprint", sha_prefix("source_key", 8))
        .withColumn("library_id", F.concat(stem, F.lit("__"), F.col("fingerprint")))
    )


def entry_identity(df: DataFrame, relative_path: str = "relative_path") -> DataFrame:
    """Add ``entry_id`` of a library file."""
    return df.withColumn("entry_id", sha_prefix(F.lower(slashed(relative_path)), 12))


def file_cache_key(
    df: DataFrame, version: str, path: str = "path", size: str = "length", modified_ns: str = "modified_ns"
) -> DataFrame:
    """Add ``cache_key``: changes with path, size, modification time or format version."""
    material = F.concat_ws(
        "|", F.col(path), F.col(size).cast("string"), F.col(modified_ns).cast("string"), F.lit(version)
    )
    return df.withColumn("cache_key", sha_prefix(material, 16))


def normalize_codec(df: DataFrame, codec: str = "codec", name: str = "normalized_codec") -> DataFrame:
    text = F.lower(F.trim(F.coalesce(F.col(codec), F.lit(""))))

    def any_of(*needles: str) -> Column:
        return text.rlike("|".join(needles))

    return df.withColumn(
        name, F.when(any_of("hevc", "h265", "x265"), F.lit("h265")).when(any_of("h264", "avc", "x264"), F.lit("h264"))
    )


def timestamp_millis(value: Column | str) -> Column:
    """Epoch seconds (below 1e12) or milliseconds as milliseconds; anything unusable is 0."""
    number = (F.col(value) if isinstance(value, str) else value).cast("string").try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (number > 0) & (number < float("inf"))
    return F.when(usable, F.when(number < 1e12, number * 1000).otherwise(number)).otherwise(F.lit(0.0))


def normalize_timestamp(df: DataFrame, column: str = "created_at", name: str = "millis") -> DataFrame:
    return df.withColumn(name, timestamp_millis(column))


def validate_requests(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Add ``errors`` and ``warnings`` (arrays of codes) to every request.

    ``models``: ``model_id, task, execution_status``. Lookups are equi-joins; Spark chooses how.
    """
    facts = models.select(
        F.col("model_id").alias("_id"), F.struct("task", "execution_status").alias("_fact")
    )
    joined = requests
    for side in ("model", "denoiser", "colorizer"):
        renamed = facts.select(F.col("_id").alias(f"_{side}_id"), F.col("_fact").alias(f"_{side}"))
        joined = joined.join(renamed, F.col(f"{side}_model_id" if side != "model" else "model_id") == F.col(f"_{side}_id"), "left")
    precision = F.nullif(F.lower(F.trim("precision")), F.lit(""))
    fp16, bf16 = F.coalesce("fp16", F.lit(False)), F.coalesce("bf16", F.lit(False))
    motion = F.col("interpolation_mode") != "off"
    target = F.col("interpolation_target_fps")
    denoise, color = F.col("denoise_mode") != "off", F.col("colorization_mode") != "off"

    def code(condition: Column, text: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(text))

    def helper(enabled: Column, side: str, task: str) -> list[Column]:
        given = F.col(f"{side}_model_id").isNotNull()
        fact = F.col(f"_{side}")
        return [
            code(enabled & ~given, f"missing {side}"),
            code(enabled & given & fact.isNull(), f"unknown {side}"),
            code(enabled & (fact["execution_status"] != "runnable"), f"{side} not runnable"),
            code(enabled & (fact["task"] != task), f"{side} has another task"),
        ]

    upscaling = F.col("colorization_mode") != "colorizeOnly"
    errors = [
        code(~F.col("interpolation_mode").isin(*INTERPOLATION_MODES), "unsupported interpolation mode"),
        code(motion & (target.isNull() | ~target.isin(*INTERPOLATION_FPS)), "unsupported target fps"),
        code(motion & (target < F.col("source_fps") - 0.01), "target fps below source"),
        code(~precision.isin(*PRECISIONS), "unsupported precision"),
        code(fp16 & bf16, "fp16 and bf16 conflict"),
        code(fp16 & (precision != "fp16"), "precision conflicts with fp16"),
        code(bf16 & (precision != "bf16"), "precision conflicts with bf16"),
        code(upscaling & F.col("_model").isNull(), "unknown model"),
        code(upscaling & (F.col("_model")["execution_status"] != "runnable"), "model not runnable"),
        *helper(denoise, "denoiser", "denoise"),
        *helper(color, "colorizer", "colorize"),
    ]
    warnings = [code(motion & (F.col("source_fps") >= target), "source already at target fps")]
    return joined.select(
        *requests.columns,
        F.array_compact(F.array(*errors)).alias("errors"),
        F.array_compact(F.array(*warnings)).alias("warnings"),
    )


def validate_selections(picks: DataFrame) -> DataFrame:
    """Add ``errors`` for blind picks and ratings: enough candidates, winner among them, rating within 1..5."""

    def code(condition: Column, text: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(text))

    checks = []
    if "candidates" in picks.columns:
        checks += [
            code(F.size("candidates") < 2, "fewer than two candidates"),
            code(~F.array_contains("candidates", F.col("winner")), "winner is not a candidate"),
        ]
    if "rating" in picks.columns:
        checks.append(code(~F.col("rating").between(1, 5), "rating outside 1 to 5"))
    return picks.withColumn("errors", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, rejected rows)."""
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)


def missing_references(requests: DataFrame, files: DataFrame, key: str = "request_id") -> DataFrame:
    """Requested reference paths that are not in ``files(path)``."""
    wanted = requests.select(key, F.explode("reference_paths").alias("path"))
    return wanted.join(files.select("path").distinct(), "path", "left_anti").select(key, "path")


def distinct_sorted(df: DataFrame, column: str, name: str = "values") -> DataFrame:
    """Sorted distinct integers of a comma list; ``error`` is set for a bad item or an empty list."""
    items = F.filter(F.transform(F.split(column, ","), lambda t: F.trim(t)), lambda t: t != "")
    numbers = F.transform(items, lambda t: t.try_cast("int"))
    # parsed once in a column of its own: higher-order functions are not shared between expressions
    parsed = df.withColumn("_numbers", F.array_sort(F.array_distinct(numbers)))
    bad = F.array_size(F.array_compact("_numbers")) < F.size("_numbers")
    error = F.when(bad, F.lit("not an integer")).when(
        F.size("_numbers") == 0, F.lit("at least one value is required")
    )
    return parsed.withColumn("error", error).withColumn(
        name, F.when(F.col("error").isNull(), F.col("_numbers"))
    ).drop("_numbers")


def distinct_in_order(df: DataFrame, column: str, allowed: Sequence[str], name: str = "values") -> DataFrame:
    """Distinct lower-cased items of a comma list in first-seen order; ``error`` for an unknown item or none."""
    items = F.filter(F.transform(F.split(column, ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    parsed = df.withColumn("_items", F.array_distinct(items))
    unknown = F.size(F.array_except("_items", F.array(*[F.lit(a) for a in allowed]))) > 0
    error = F.when(unknown, F.lit("unsupported value")).when(
        F.size("_items") == 0, F.lit("at least one value is required")
    )
    return parsed.withColumn("error", error).withColumn(
        name, F.when(F.col("error").isNull(), F.col("_items"))
    ).drop("_items")


def same_candidate_set(left: Column | str, right: Column | str) -> Column:
    """Order-insensitive equality of two lists, duplicates counted."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (left, right))
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


# Fields of a comparison signature, in their canonical order.
SIGNATURE_FIELDS = (
    ("sourcePath", "source_path"),
    ("previewDurationSeconds", "preview_duration_seconds"),
    ("previewStartOffsetSeconds", "preview_start_offset_seconds"),
    ("colorizationMode", "colorization_mode"),
    ("interpolationMode", "interpolation_mode"),
    ("upscaleModelId", "upscale_model_id"),
    ("candidateModelIds", "candidates"),
    ("deepremasterProcessingMode", "processing_mode"),
)


def _js_number(value: Column) -> Column:
    """A number as a script engine prints it: no fraction for whole values."""
    return F.when(value == F.floor(value), F.floor(value).cast("bigint").cast("string")).otherwise(value.cast("string"))


def comparison_signature(df: DataFrame, name: str = "signature") -> DataFrame:
    """Add the canonical JSON text of a comparison: lists sorted, the offset rounded to 3 decimals.

    ``context`` is null or ``STRUCT<library_id, entry_ids, reference_paths>``.
    """

    def render(c: str) -> Column:
        if c == "preview_start_offset_seconds":
            return _js_number(F.round(F.col(c).cast("double"), 3))
        if c == "preview_duration_seconds":
            return _js_number(F.col(c).cast("double"))
        if c == "candidates":
            return F.to_json(F.array_sort(c))
        return F.coalesce(_quoted(F.col(c)), F.lit("null"))

    parts = [F.concat(F.lit(f'"{label}":'), render(c)) for label, c in SIGNATURE_FIELDS]
    context = F.lit("null")
    if "context" in df.columns:
        detail = F.to_json(
            F.struct(
                F.col("context.library_id").alias("libraryId"),
                F.array_sort("context.entry_ids").alias("selectedEntryIds"),
                F.array_sort("context.reference_paths").alias("referenceImagePaths"),
            )
        )
        context = F.when(F.col("context").isNotNull(), detail).otherwise(context)
    parts.append(F.concat(F.lit('"colorizationContext":'), context))
    return df.withColumn(name, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def _quoted(value: Column) -> Column:
    """JSON text of a string column (null stays null)."""
    wrapped = F.to_json(F.array(value.cast("string")))
    return F.when(value.isNotNull(), F.substring(wrapped, F.lit(2), F.length(wrapped) - 2))
