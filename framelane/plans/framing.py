"""Per-source planning of canvas, crop, scale, quality policy and preview window (projections only, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framelane.functions.numeric import clamp_unit, round_dimension, round_half_even, round_half_up, safe_div

RATIO_EPSILON = 1e-4
UHD_WIDTH, UHD_HEIGHT = 3840, 2160

# Tile size by backend and preset (0 means untiled); other backends use the "*" row.
TILE_POLICY = {
    "pytorch-image-sr": {"qualityMax": 512, "qualityBalanced": 384, "*": 256},
    "pytorch-video-sr": {"qualityMax": 256, "qualityBalanced": 192, "*": 128},
    "*": {"qualityMax": 0, "qualityBalanced": 256, "*": 128},
}
# Precision by preset for the backends that can choose one.
PRECISION_POLICY = {"qualityMax": "fp32", "qualityBalanced": "bf16", "*": "fp16"}
PRECISION_BACKENDS = ("pytorch-image-sr", "pytorch-video-sr")


def source_ratio() -> Column:
    return safe_div("source_width", "source_height")


def aspect_ratio() -> Column:
    """`source`, `custom` or `w:h`; anything unusable falls back to the source ratio."""
    custom = F.when(
        (F.col("custom_aspect_width") > 0) & (F.col("custom_aspect_height") > 0),
        safe_div("custom_aspect_width", "custom_aspect_height"),
    )
    parts = F.split(F.col("aspect_ratio_preset"), ":", 2)
    width = F.trim(F.get(parts, 0)).try_cast("double")
    height = F.trim(F.get(parts, 1)).try_cast("double")
    preset = F.when((width > 0) & (height > 0), width / height)
    chosen = (
        F.when(F.col("aspect_ratio_preset") == "source", F.lit(None).cast("double"))
        .when(F.col("aspect_ratio_preset") == "custom", custom)
        .otherwise(preset)
    )
    return F.coalesce(chosen, source_ratio())


def resolve_aspect_ratio(df: DataFrame) -> DataFrame:
    """Add ``aspect_ratio``."""
    return df.withColumn("aspect_ratio", aspect_ratio())


def resolve_output_canvas(df: DataFrame, rounding: str = "half_even") -> DataFrame:
    """Add ``aspect_ratio``, ``canvas_width`` and ``canvas_height``."""
    ratio, basis = F.col("aspect_ratio"), F.col("resolution_basis")
    width = F.when(F.col("target_width") > 0, F.col("target_width").cast("double"))
    height = F.when(F.col("target_height") > 0, F.col("target_height").cast("double"))
    has_w, has_h = width.isNotNull(), height.isNotNull()
    native = (F.col("output_mode") == "native4x") & (F.abs(ratio - source_ratio()) < RATIO_EPSILON)
    by_width = ((basis == "width") & has_w) | (has_w & ~has_h)
    by_height = ((basis == "height") & has_h) | (has_h & ~has_w)
    exact = (basis == "exact") & has_w & has_h

    def dim(value: Column) -> Column:
        return round_dimension(value, rounding)

    canvas_width = (
        F.when(exact | by_width, dim(width))
        .when(by_height, dim(height * ratio))
        .when(native, dim(F.col("source_width") * 2))
        .when(ratio >= 1, F.lit(UHD_WIDTH).cast("bigint"))
        .otherwise(dim(F.lit(UHD_HEIGHT) * ratio))
    )
    canvas_height = (
        F.when(exact, dim(height))
        .when(by_width, dim(safe_div(width, ratio)))
        .when(by_height, dim(height))
        .when(native, dim(F.col("source_height") * 2))
        .when(ratio >= 1, dim(safe_div(F.lit(UHD_WIDTH), ratio)))
        .otherwise(F.lit(UHD_HEIGHT).cast("bigint"))
    )
    return resolve_aspect_ratio(df).withColumns({"canvas_width": canvas_width, "canvas_height": canvas_height})


def clamp_crop(df: DataFrame) -> DataFrame:
    """Clamp the requested normalised crop into the frame; all four stay null unless all four were given."""
    given = (
        F.col("crop_left").isNotNull()
        & F.col("crop_top").isNotNull()
        & F.col("crop_width").isNotNull()
        & F.col("crop_height").isNotNull()
    )
    width, height = clamp_unit("crop_width"), clamp_unit("crop_height")

    def offset(name: str, size: Column) -> Column:
        return F.least(F.greatest(F.lit(0.0), F.col(name).cast("double")), F.greatest(F.lit(0.0), F.lit(1.0) - size))

    return df.select(
        *[c for c in df.columns if c not in ("crop_left", "crop_top", "crop_width", "crop_height")],
        F.when(given, offset("crop_left", width)).alias("crop_left"),
        F.when(given, offset("crop_top", height)).alias("crop_top"),
        F.when(given, width).alias("crop_width"),
        F.when(given, height).alias("crop_height"),
    )


def default_crop(df: DataFrame) -> DataFrame:
    """Add the centred ``default_left/top/width/height`` that turns the source ratio into the requested one."""
    ratio, source = F.col("aspect_ratio"), source_ratio()
    same = F.abs(ratio - source) < RATIO_EPSILON
    wider = ratio > source
    width = F.when(same | wider, F.lit(1.0)).otherwise(safe_div(ratio, source))
    height = F.when(same | ~wider, F.lit(1.0)).otherwise(safe_div(source, ratio))
    return resolve_aspect_ratio(df).withColumns(
        {
            "default_left": (F.lit(1.0) - width) / 2,
            "default_top": (F.lit(1.0) - height) / 2,
            "default_width": width,
            "default_height": height,
        }
    )


def plan_framing(df: DataFrame) -> DataFrame:
    """Canvas, scaled size and crop window per row, with the half-up rounding of the framing preview."""
    planned = clamp_crop(default_crop(resolve_output_canvas(df, "half_up")))
    cropping = F.col("output_mode") == "cropTo4k"
    native = (F.col("output_mode") == "native4x") & (F.abs(F.col("aspect_ratio") - source_ratio()) < RATIO_EPSILON)

    def crop(part: str, whole: float) -> Column:
        return F.when(cropping, F.coalesce(F.col(f"crop_{part}"), F.col(f"default_{part}"))).otherwise(F.lit(whole))

    planned = planned.withColumns(
        {"_l": crop("left", 0.0), "_t": crop("top", 0.0), "_w": crop("width", 1.0), "_h": crop("height", 1.0)}
    )
    sw, sh = F.col("source_width"), F.col("source_height")
    fit = F.least(safe_div("canvas_width", sw), safe_div("canvas_height", sh))
    scale_w = F.when(cropping, safe_div(F.col("canvas_width"), sw * F.col("_w"))).otherwise(fit)
    scale_h = F.when(cropping, safe_div(F.col("canvas_height"), sh * F.col("_h"))).otherwise(fit)

    def dim(value: Column) -> Column:
        return round_dimension(value, "half_up")

    return planned.withColumns(
        {
            "scaled_width": F.when(native, F.col("canvas_width")).otherwise(dim(sw * scale_w)),
            "scaled_height": F.when(native, F.col("canvas_height")).otherwise(dim(sh * scale_h)),
            "window_width": F.when(native, sw).otherwise(F.least(sw, dim(sw * F.col("_w")))).cast("bigint"),
            "window_height": F.when(native, sh).otherwise(F.least(sh, dim(sh * F.col("_h")))).cast("bigint"),
            "offset_x": F.when(native, F.lit(0).cast("bigint")).otherwise(round_half_up(sw * F.col("_l"))),
            "offset_y": F.when(native, F.lit(0).cast("bigint")).otherwise(round_half_up(sh * F.col("_t"))),
        }
    ).drop("_l", "_t", "_w", "_h")


def required_scale(df: DataFrame) -> DataFrame:
    """Add ``scale``: 2 to 4 when only the aspect has to be kept, else 4."""
    need = F.least(safe_div("canvas_width", "source_width"), safe_div("canvas_height", "source_height"))
    usable = (
        (F.col("output_mode") == "preserveAspect4k") & (F.col("source_width") > 0) & (F.col("source_height") > 0)
    )
    fitted = F.greatest(F.lit(2), F.least(F.lit(4), F.ceil(need - RATIO_EPSILON)))
    return df.withColumn("scale", F.when(usable, fitted).otherwise(F.lit(4)).cast("bigint"))


def _lookup(policy: dict, preset: Column) -> Column:
    default = F.lit(policy["*"])
    out = None
    for key, value in policy.items():
        if key != "*":
            out = F.when(preset == key, F.lit(value)) if out is None else out.when(preset == key, F.lit(value))
    return out.otherwise(default)


def quality_policy(df: DataFrame) -> DataFrame:
    """Add effective tile size, selected precision and where the precision came from.

    Reads ``backend_id, quality_preset, tile_size, precision, fp16, bf16``. The policy is a handful of constants, so
    it is a CASE expression rather than a join.
    """
    preset, backend = F.col("quality_preset"), F.col("backend_id")
    tile = None
    for name, policy in TILE_POLICY.items():
        if name != "*":
            tile = F.when(backend == name, _lookup(policy, preset)) if tile is None else tile.when(
                backend == name, _lookup(policy, preset)
            )
    tile = tile.otherwise(_lookup(TILE_POLICY["*"], preset))
    fp16, bf16 = F.coalesce(F.col("fp16"), F.lit(False)), F.coalesce(F.col("bf16"), F.lit(False))
    named = F.when(F.length(F.trim(F.col("precision"))) > 0, F.lower(F.trim(F.col("precision"))))
    explicit = fp16 | bf16 | named.isNotNull()
    requested = F.coalesce(named, F.when(fp16, F.lit("fp16")), F.when(bf16, F.lit("bf16")))
    choosable = backend.isin(*PRECISION_BACKENDS)
    return df.withColumns(
        {
            "effective_tile_size": F.when(F.col("tile_size") > 0, F.col("tile_size")).otherwise(tile).cast("bigint"),
            "requested_precision": F.when(explicit, requested),
            "selected_precision": F.when(explicit, requested)
            .when(choosable, _lookup(PRECISION_POLICY, preset))
            .otherwise(F.lit("fp32")),
            "precision_source": F.when(explicit, F.lit("explicit-request"))
            .when(choosable, F.lit("preset-default"))
            .otherwise(F.lit("backend-fixed")),
        }
    )


def preview_window(df: DataFrame, epsilon: float = 1e-9, default_seconds: float = 8.0) -> DataFrame:
    """Add ``start_frame, start_seconds, window_frames, window_seconds``.

    ``epsilon`` is 1e-9 in the worker and 1e-6 in the player; both snap an offset up to the next frame.
    """
    fps, duration = F.col("frame_rate").cast("double"), F.col("duration_seconds").cast("double")
    usable = (fps > 0) & (duration > 0)
    preview = F.coalesce(F.col("preview_mode"), F.lit(False))
    total = F.greatest(F.lit(1).cast("bigint"), round_half_even(fps * duration))
    offset = F.greatest(F.lit(0.0), F.least(F.col("preview_start_offset_seconds").cast("double"), duration))
    shifted = preview & usable & (F.col("preview_start_offset_seconds") > 0)
    start = F.when(
        shifted,
        F.least(total - 1, F.greatest(F.lit(0).cast("bigint"), F.ceil(offset * fps - F.lit(epsilon)).cast("bigint"))),
    ).otherwise(F.lit(0).cast("bigint"))
    wanted = F.when(F.col("preview_duration_seconds") > 0, F.col("preview_duration_seconds").cast("double")).otherwise(
        F.lit(default_seconds)
    )
    frames = (
        F.when(~usable, F.lit(1).cast("bigint"))
        .when(~preview, total)
        .otherwise(
            F.least(
                F.greatest(F.lit(1).cast("bigint"), total - F.col("start_frame")),
                F.greatest(F.lit(1).cast("bigint"), round_half_even(fps * wanted)),
            )
        )
    )
    usable = F.coalesce(usable, F.lit(False))
    return (
        df.withColumn("start_frame", start)
        .withColumn("window_frames", frames)
        .withColumns(
            {
                "start_seconds": F.when(usable, safe_div("start_frame", fps)).otherwise(F.lit(0.0)),
                "window_seconds": F.when(~usable, F.lit(0.0))
                .when(~preview, duration)
                .otherwise(safe_div("window_frames", fps)),
            }
        )
    )


def media_summary(df: DataFrame) -> DataFrame:
    """Add ``aspect_ratio, pixel_count, pixels_per_second, ratio_label`` from ``width, height, frame_rate``."""
    width, height = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    # Euclid's algorithm as a bounded fold: 64 steps are enough for any pair below 2^44 (Fibonacci bound).
    gcd = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        F.struct(F.abs(width).alias("a"), F.abs(height).alias("b")),
        lambda acc, _: F.struct(
            F.when(acc["b"] == 0, acc["a"]).otherwise(acc["b"]).alias("a"),
            F.when(acc["b"] == 0, acc["b"]).otherwise(acc["a"] % F.nullif(acc["b"], F.lit(0).cast("bigint"))).alias("b"),
        ),
        lambda acc: acc["a"],
    )
    pixels = F.greatest(F.lit(0).cast("bigint"), width * height)
    known = (width > 0) & (height > 0)
    return df.withColumns(
        {
            "aspect_ratio": F.when(height != 0, safe_div(width, height)).otherwise(F.lit(0.0)),
            "pixel_count": pixels,
            "pixels_per_second": F.when((pixels > 0) & (F.col("frame_rate") > 0), pixels * F.col("frame_rate")),
            "_gcd": gcd,
        }
    ).withColumn(
        "ratio_label",
        F.when(
            known,
            F.concat_ws(
                ":", F.expr("CAST(width DIV _gcd AS STRING)"), F.expr("CAST(height DIV _gcd AS STRING)")
            ),
        ).otherwise(F.lit("Unknown")),
    ).drop("_gcd")
