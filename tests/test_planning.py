"""Planner results with known values."""

import pytest
from pyspark.sql import functions as F

from framelane.operators import telemetry
from framelane.plans import framing, segments, tiles


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def clips(spark, *values):
    return spark.createDataFrame(list(values), "source_id string, frame_count bigint, frame_rate double")


def test_segments(spark):
    got = rows(segments.plan_segments(clips(spark, ("a", 720, 24.0))), "segment_index", "start_frame", "frame_count")
    assert got == [(0, 0, 240), (1, 240, 240), (2, 480, 240)]
    single = segments.plan_segments(clips(spark, ("a", 180, 24.0)), single=True)
    assert rows(single, "frame_count", "duration_seconds") == [(180, 7.5)]
    longer = segments.plan_segments(clips(spark, ("a", 720, 24.0)), seconds=20)
    assert rows(longer, "frame_count") == [(480,), (240,)]
    assert segments.plan_segments(clips(spark, ("a", 0, 24.0))).count() == 0
    slow = segments.plan_segments(clips(spark, ("a", 100, 0.0)))
    assert rows(slow, "frame_count", "start_seconds") == [(48, 0.0), (48, 48.0), (4, 96.0)]


def halos(spark, count=300):
    source = clips(spark, ("a", count, 24.0)).withColumns({"fps": F.lit(24.0), "target": F.lit(60.0)})
    return segments.plan_halos(segments.plan_segments(source, keys=("source_id", "fps", "target")), "fps", "target")


def test_halos(spark):
    got = rows(halos(spark), "expanded_start", "expanded_count", "output_start", "output_count", "overlap_before")
    assert got == [(0, 241, 0, 600, 0), (239, 61, 2, 150, 1)]


def test_shrink_last_segment(spark):
    actual = spark.createDataFrame(
        [("a", 0, 241), ("a", 1, 50)], "source_id string, segment_index bigint, actual_count bigint"
    )
    accepted, rejected = segments.shrink_last_segment(halos(spark), actual, "fps", "target")
    last = accepted.where("segment_index = 1").first()
    assert (last.frame_count, last.expanded_count, last.output_count, last.overlap_after) == (49, 50, 122, 0)
    assert rejected.count() == 0
    bad = spark.createDataFrame([("a", 0, 200)], "source_id string, segment_index bigint, actual_count bigint")
    _, rejected = segments.shrink_last_segment(halos(spark), bad, "fps", "target")
    assert sorted(rows(rejected, "segment_index", "error")) == [
        (0, "expected 241 frames, read 200"),
        (1, "expected 61 frames, read none"),
    ]


def test_output_frames(spark):
    one = spark.range(1)
    for start in (0, 24):
        assert one.select(segments.output_frame_count(F.lit(start), F.lit(24), 24.0, 60.0)).first()[0] == 60
    assert one.select(segments.skip_interpolation(F.lit(300), F.lit(300))).first()[0] is True
    assert one.select(segments.skip_interpolation(F.lit(300), F.lit(750))).first()[0] is False


def percent(spark, **given):
    base = dict(
        total_frames=48, source_total_frames=None, extracted_frames=0, denoised_frames=0, colorized_frames=0,
        upscaled_frames=0, interpolated_frames=0, encoded_frames=0, remuxed_frames=0, mode="off",
    )
    base.update(given)
    schema = ", ".join(f"{k} {'string' if k == 'mode' else 'bigint'}" for k in base)
    df = spark.createDataFrame([tuple(base.values())], schema)
    out = telemetry.progress_percent(df, F.col("mode"), F.lit("off"), F.lit("off")).first()
    return out.percent, out.processed_frames


def test_percent(spark):
    assert percent(spark, extracted_frames=48, upscaled_frames=24, encoded_frames=12)[0] == 49
    scaled = dict(total_frames=80000, source_total_frames=26667, extracted_frames=2667, interpolated_frames=8000)
    assert percent(spark, **scaled, mode="interpolateOnly") == (8, 8001)
    assert percent(spark, **scaled, upscaled_frames=2667, mode="afterUpscale")[0] == 8


@pytest.mark.parametrize(
    "backend, preset, tile, precision",
    [
        ("realesrgan-ncnn", "qualityBalanced", 256, "fp32"),
        ("pytorch-image-sr", "qualityBalanced", 384, "bf16"),
        ("pytorch-image-sr", "vramSafe", 256, "fp16"),
        ("pytorch-image-sr", "qualityMax", 512, "fp32"),
        ("pytorch-video-sr", "qualityMax", 256, "fp32"),
        ("pytorch-video-sr", "qualityBalanced", 192, "bf16"),
        ("pytorch-video-sr", "vramSafe", 128, "fp16"),
        ("realesrgan-ncnn", "qualityMax", 0, "fp32"),
    ],
)
def test_quality_policy(spark, backend, preset, tile, precision):
    schema = "backend_id string, quality_preset string, tile_size int, precision string, fp16 boolean, bf16 boolean"
    out = framing.quality_policy(spark.createDataFrame([(backend, preset, 0, None, False, False)], schema)).first()
    assert (out.effective_tile_size, out.selected_precision) == (tile, precision)
    explicit = framing.quality_policy(spark.createDataFrame([(backend, preset, 64, "fp32", False, False)], schema)).first()
    assert (explicit.effective_tile_size, explicit.selected_precision) == (64, "fp32")
    assert explicit.precision_source == "explicit-request"


def size(spark, width, height, mode, preset="source", basis="exact", target=(None, None)):
    schema = (
        "source_width int, source_height int, output_mode string, aspect_ratio_preset string, custom_aspect_width int, "
        "custom_aspect_height int, resolution_basis string, target_width int, target_height int, crop_left double, "
        "crop_top double, crop_width double, crop_height double"
    )
    row = (width, height, mode, preset, None, None, basis, *target, None, None, None, None)
    return spark.createDataFrame([row], schema)


def test_scale_and_framing(spark):
    keep = framing.required_scale(framing.resolve_output_canvas(size(spark, 966, 720, "preserveAspect4k", target=(3840, 2160))))
    crop = framing.required_scale(framing.resolve_output_canvas(size(spark, 966, 720, "cropTo4k", target=(3840, 2160))))
    assert (keep.first().scale, crop.first().scale) == (3, 4)
    plan = framing.plan_framing(size(spark, 1280, 720, "preserveAspect4k", "16:9", "preset")).first()
    assert (plan.canvas_width, plan.canvas_height, plan.scaled_width, plan.scaled_height) == (3840, 2160, 3840, 2160)
    native = framing.plan_framing(size(spark, 640, 360, "native4x", basis="preset")).first()
    assert (native.canvas_width, native.canvas_height) == (1280, 720)
    square = framing.plan_framing(size(spark, 1920, 1080, "cropTo4k", "1:1", "preset")).first()
    assert (square.window_width, square.window_height, square.offset_x) == (1080, 1080, 420)


def test_rounding_modes(spark):
    from framelane.functions.numeric import round_dimension

    df = spark.createDataFrame([(4.5,), (5.5,), (0.2,)], "v double")
    assert rows(df, round_dimension("v"), round_dimension("v", "half_up")) == [(4, 6), (6, 6), (2, 2)]


def test_tiles_cover_every_pixel_once(spark):
    sizes = [(64, 48), (100, 70), (257, 31), (16, 16)]
    df = spark.createDataFrame(sizes, "width int, height int")
    for tile in (16, 32, 100):
        plan = tiles.plan_tiles(df, tile).collect()
        for w, h in sizes:
            area = sum(
                (r.crop_bottom - r.crop_top) * (r.crop_right - r.crop_left) for r in plan if (r.width, r.height) == (w, h)
            )
            assert area == w * h


def test_temporal_padding(spark):
    plan = segments.plan_temporal_chunks(clips(spark, ("a", 3, 24.0)), chunk=32).first()
    assert (plan.expanded_end, plan.trim_start, plan.trim_end, plan.pad_frames) == (3, 0, 3, 2)


def test_resample_totals(spark):
    frames = spark.createDataFrame([("a", i) for i in range(7)], "source_id string, frame_index int")
    for out_fps, total in ((60.0, 18), (30.0, 9), (24.0, 7), (12.0, 7)):
        got = segments.resample_timeline(frames, 24.0, out_fps).orderBy("output_index").collect()
        assert [r.output_index for r in got] == list(range(total))
        assert all(0 <= r.left_index <= r.right_index <= 6 for r in got)
    held = segments.resample_timeline(frames, 30.0, 60.0, how="duplicate").orderBy("output_index").collect()
    assert [r.left_index for r in held] == [i // 2 for i in range(14)]


def test_event_times(spark):
    df = spark.createDataFrame([("a", 3.0, 1.0), ("b", 0.0, 1.0), ("c", 1.0, 0.3)], "media_id string, duration_seconds double, interval_seconds double")
    got = rows(segments.event_times(df), "media_id", "event_seconds")
    assert got == [("a", 0.0), ("a", 1.0), ("a", 2.0), ("c", 0.0), ("c", 0.3), ("c", 0.6), ("c", 0.9)]


def test_the_last_segment_never_meets_a_broadcast_of_all_plans(spark):
    """A million segments come from a small table: the plan must not bring them to the driver."""
    from framelane.bindings import QUERIES

    plan = QUERIES["shrink_last_segment"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_sources_are_dealt_over_tasks_by_their_number(spark):
    from framelane.bindings import planning

    assert planning.spread(spark.range(25_000).coalesce(1)).rdd.getNumPartitions() == 3
    assert planning.spread(spark.range(9).coalesce(1)).rdd.getNumPartitions() == 1


def test_table_functions_do_not_make_a_table_per_row(spark):
    from framelane.bindings import QUERIES

    plan = QUERIES["sql_tile_plan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
