"""Readers and sinks on small files."""

import json

import numpy as np
import pytest
from images import write_png
from pyspark.sql import functions as F

from framelane.operators import catalog, jobs, library, runs
from framelane.sources import media, readers, sinks


def dump(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_frames_and_rejects(spark, tmp_path):
    clip = tmp_path / "clip_a"
    clip.mkdir()
    rng = np.random.default_rng(0)
    images = [rng.integers(0, 256, (6, 9, 3)) for _ in range(3)]
    for i in (2, 0, 1):
        write_png(clip / f"frame_{i + 1:08d}.png", images[i])
    (clip / "frame_00000009.png").write_bytes(b"not an image")
    write_png(clip / "frame_x.png", images[0])
    frames = readers.read_frames(spark, str(tmp_path), role="master").orderBy("frame_index").collect()
    assert [(r.source_id, r.role, r.frame_index, r.width, r.height, r.channels) for r in frames] == [
        ("clip_a", "master", i, 9, 6, 3) for i in (1, 2, 3)
    ]
    for row, rgb in zip(frames, images):
        bgr = np.frombuffer(bytes(row.pixels), dtype=np.uint8).reshape(6, 9, 3)
        assert np.array_equal(bgr[:, :, ::-1], rgb)
    rejects = {r.origin.rsplit("/", 1)[1]: r.reason for r in readers.frame_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {"frame_00000009.png": "not decodable", "frame_x.png": "no frame number"}


CATALOG = {
    "backends": [
        {"id": "pytorch-video-sr", "label": "Video SR", "supportsGpuSelection": True},
        {"id": "tool", "label": "Tool"},
    ],
    "models": [
        {"id": "m1", "backendId": "tool", "label": "b", "visibleInUi": True, "comparisonEligible": True, "executionStatus": "runnable", "qualityRank": 7},
        {"id": "m2", "backendId": "pytorch-video-sr", "label": "A", "supportTier": "research", "qualityRank": 2},
        {"id": "m3", "backendId": "gone", "label": "c", "task": "denoise", "executionStatus": "runnable"},
    ],
}


def test_catalog(spark, tmp_path):
    dump(tmp_path / "catalog.json", CATALOG)
    models, backends = readers.read_catalog(spark, str(tmp_path / "catalog.json"))
    rows = {r.model_id: r for r in models.collect()}
    assert (rows["m1"].task, rows["m2"].execution_status, rows["m3"].quality_rank, rows["m1"].support_tier) == (
        "upscale", "planned", 999, "next",
    )

    def ids(kind, task="upscale"):
        return {r.model_id for r in catalog.catalog_filter(models, kind, task).collect()}

    assert ids("visible") == {"m1"} and ids("ui") == {"m1", "m2"} and ids("comparison") == {"m1"}
    assert ids("top_rated") == {"m2"} and ids("benchmarkable") == {"m1", "m2"} and ids("runnable", "denoise") == {"m3"}
    known, unknown = catalog.models_with_backends(models, backends)
    assert {r.backend_label for r in known.collect()} == {"Video SR", "Tool"}
    assert [r.model_id for r in unknown.collect()] == ["m3"]
    ranked = catalog.rank_models(models.where("task = 'upscale'")).orderBy("rank_position").collect()
    assert [r.model_id for r in ranked] == ["m2", "m1"]


def run(wall, fps, status="completed", rss=None):
    return {
        "status": status, "wallSeconds": wall, "averageThroughputFps": fps, "frameCount": 60,
        "stageTimings": {"extractSeconds": 2.0, "encodeSeconds": 4.0, "remuxSeconds": 0.0},
        "resourcePeaks": {"processRssBytes": rss}, "gpuActivity": {"maxUtilizationPercent": 50},
    }


def test_benchmark_runs(spark, tmp_path):
    payload = {
        "fixture": {"durationSeconds": 2.0, "fps": 12},
        "results": [
            {"executionPath": "file-io", "runs": [run(9.0, 1.0, "not-implemented")]},
            {"executionPath": "streaming", "runs": [run(4.0, "bad", rss=100), run(1.0, 5.0), run(9.0, 2.0, rss=300)]},
        ],
    }
    dump(tmp_path / "bench.json", payload)
    table = readers.read_benchmark_runs(spark, str(tmp_path / "bench.json"))
    assert [(r.path_ordinal, r.run_ordinal) for r in table.orderBy("path_ordinal", "run_ordinal").collect()] == [
        (0, 0), (1, 0), (1, 1), (1, 2),
    ]
    chosen = runs.select_execution_path(table)
    assert {r.execution_path for r in chosen.collect()} == {"streaming"}
    medians = {r.metric: r.median for r in runs.summarize_runs(chosen).collect()}
    assert medians["wall_seconds"] == 4.0 and medians["process_rss_bytes"] == 200.0
    assert medians["average_throughput_fps"] == 3.5  # the mistyped number counts as missing
    assert medians["extract_fps"] == 12.0 and medians["encode_fps"] == 15.0 and "remux_fps" not in medians
    with pytest.raises(Exception, match="no completed benchmark runs"):
        runs.select_execution_path(table, "file-io").collect()


def test_run_comparison_signs(spark):
    schema = "metric string, median double"
    before = spark.createDataFrame([("wall_seconds", 10.0), ("extract_fps", 0.0), ("gpu_memory_used_bytes", 5.0)], schema)
    after = spark.createDataFrame([("wall_seconds", 8.0), ("extract_fps", 3.0), ("scratch_size_bytes", 1.0)], schema)
    got = {r.metric: r for r in runs.compare_runs(before, after).collect()}
    assert (got["wall_seconds"].percent_change, got["wall_seconds"].improvement_percent) == (-20.0, 20.0)
    assert (got["extract_fps"].delta, got["extract_fps"].percent_change) == (3.0, None)
    assert got["scratch_size_bytes"].delta is None and got["gpu_memory_used_bytes"].after is None


def test_manifest(spark, tmp_path):
    dump(tmp_path / "m.json", {"name": "x", "entries": [{"master": "a", "degraded": "b"}, {"degraded": "c"}]})
    rows = readers.read_fixture_manifest(spark, str(tmp_path / "m.json")).orderBy("frame_index").collect()
    assert [(r.frame_index, r.master, r.degraded) for r in rows] == [(0, "a", "b"), (1, None, "c")]
    dump(tmp_path / "empty.json", {"name": "x", "entries": []})
    with pytest.raises(Exception, match="no entries"):
        readers.read_fixture_manifest(spark, str(tmp_path / "empty.json")).collect()


def test_job_records(spark, tmp_path):
    base = {"jobKind": "pipeline", "label": "One", "progress": {"phase": "extracting", "percent": 1, "message": "x"}}
    dump(tmp_path / "a_summary.json", {**base, "jobId": "a", "state": "running", "updatedAt": "20"})
    dump(tmp_path / "broken_summary.json", "{nope")
    dump(tmp_path / "job_a_progress.json", {"phase": "completed", "percent": 100})
    dump(tmp_path / "job_old_progress.json", {"phase": "failed", "percent": 5, "message": "Cancelled by user", "outputSizeBytes": 7})
    dump(tmp_path / "job_conv_1_progress.json", {"phase": "completed", "percent": 100, "message": ""})
    records = readers.read_job_records(spark, str(tmp_path))
    got = {r.job_id: r for r in records.collect()}
    assert set(got) == {"a", "old", "conv_1"}
    assert (got["old"].state, got["old"].output_size_bytes, got["old"].label) == ("cancelled", 7, "Upscale Job")
    assert (got["conv_1"].state, got["conv_1"].job_kind, got["conv_1"].scratch_path) == ("succeeded", "sourceConversion", None)
    assert got["old"].scratch_path.endswith("/job_old")
    states = {r.job_id: r.resolved_state for r in jobs.resolve_job_state(records).collect()}
    assert states["a"] == "interrupted"


def test_preferences(spark, tmp_path):
    dump(
        tmp_path / "p.json",
        {
            "modelRatings": {"m1": {"rating": 4, "updatedAt": "9"}},
            "blindComparisons": [
                {"sourcePath": "s", "previewDurationSeconds": 8, "winnerModelId": "a", "candidateModelIds": ["a", "b"], "createdAt": "1775076243"}
            ],
        },
    )
    ratings, picks = readers.read_preferences(spark, str(tmp_path / "p.json"))
    assert [tuple(r) for r in ratings.collect()] == [("m1", 4, "9")]
    pick = picks.first()
    assert (pick.record_order, pick.winner, pick.created_ms) == (0, "a", 1775076243000)
    assert {r.model_id: r.wins for r in library.pick_tally(picks).collect()} == {"a": 1, "b": 0}


def test_inventory_reads_no_content(spark, tmp_path):
    for name, size in (("one/a.bin", 10), ("one/sub/b.bin", 5), ("two/c.bin", 1)):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x" * size)
    roots = [str(tmp_path / "one"), str(tmp_path / "two")]
    files = readers.file_inventory(spark, roots)
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    wanted = spark.createDataFrame([(r,) for r in [*roots, "/nowhere"]], "root string")
    got = {r.root: (r.exists, r.files, r.size_bytes) for r in jobs.storage_summary(files, wanted).collect()}
    assert got == {roots[0]: (True, 2, 15), roots[1]: (True, 1, 1), "/nowhere": (False, 0, 0)}


BANNER = """
Input #0, mov,mp4,m4a,3gp,3g2,mj2, from 'sample.mp4':
  Duration: 00:00:12.50, start: 0.000000, bitrate: 4123 kb/s
  Stream #0:0: Video: hevc (Main) (hev1 / 0x31766568), yuv420p(tv, bt709), 1920x1080, 23.976 fps, 23.98 tbr, 24k tbn
  Stream #0:1: Audio: aac (LC), 48000 Hz, stereo, fltp, 128 kb/s
"""


def test_media_metadata(spark):
    probes = spark.createDataFrame([("C:/fixtures/sample.mp4", BANNER), ("bad", "nothing here")], "path string, probe_text string")
    good, rejected = media.extract_media_metadata(probes)
    r = good.first()
    assert (r.video_codec, r.video_profile, r.width, r.height, r.frame_rate) == ("hevc", "Main", 1920, 1080, 23.976)
    assert (r.container, r.has_audio, r.source_bitrate_kbps, r.pixel_format) == ("mp4", True, 4123, "yuv420p(tv, bt709)")
    assert (r.audio_codec, r.audio_profile, r.audio_sample_rate, r.audio_channels, r.audio_bitrate_kbps) == (
        "aac", "LC", 48000, "stereo", 128,
    )
    assert r.duration_seconds == 12.5
    assert rejected.first().error == "no duration"


def test_segments_resume_keeps_finished(spark, tmp_path):
    target = str(tmp_path / "out")
    frames = spark.range(20).select(
        F.lit("c").alias("source_id"), F.floor(F.col("id") / 5).alias("segment_index"), F.col("id").alias("frame_index"), F.lit(1).alias("v")
    )
    sinks.write_segments(frames, target)
    sinks.write_segments(frames.where("segment_index = 2").withColumn("v", F.lit(2)), target)
    back = spark.read.parquet(target).groupBy("segment_index").agg(F.count("*").alias("n"), F.max("v").alias("v"))
    assert {r.segment_index: (r.n, r.v) for r in back.collect()} == {0: (5, 1), 1: (5, 1), 2: (5, 2), 3: (5, 1)}
    sinks.write_report(back, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 4


def test_import_names(spark):
    existing = spark.createDataFrame([("l", "a.png", "h0"), ("l", "a_3.png", "h1")], "library_id string, name string, content_hash string")
    names = [(1, "A.PNG"), (2, "a.png"), (3, "a_2.png"), (4, "a.png"), (5, "a_3.png"), (6, "##"), (7, "b"), (8, "b")]
    fresh = spark.createDataFrame([("l", s, n, f"x{s}") for s, n in names], "library_id string, seq bigint, file_name string, content_hash string")
    got = {r.seq: r.name for r in library.destination_names(existing, fresh).collect()}
    # 1 and 3 are taken, 2 is the literal name of an arrival
    assert got == {1: "a_4.png", 2: "a_5.png", 3: "a_2.png", 4: "a_6.png", 5: "a_3_2.png", 6: "context", 7: "b", 8: "b_2"}


def test_import_dedupe(spark):
    empty = spark.createDataFrame([], "library_id string, name string, content_hash string")
    incoming = spark.createDataFrame(
        [("l", "one.png", b"same", 1), ("l", "two.png", b"same", 2), ("k", "one.png", b"same", 3)],
        "library_id string, file_name string, content binary, seq bigint",
    )
    got = {(r.library_id, r.name) for r in library.dedupe_import(empty, incoming).collect()}
    assert got == {("l", "one.png"), ("k", "one.png")}


def test_overlays(spark):
    schema = "job_id string, job_kind string, state string, phase string, percent int, message string"
    df = spark.createDataFrame(
        [("1", "pipeline", "paused", "upscaling", 5, "Frame 3"), ("2", "pipeline", "paused", "completed", 100, "done"), ("3", "sourceConversion", "failed", "failed", 100, "x")],
        schema,
    )
    paused = {r.job_id: (r.phase, r.message) for r in jobs.overlay_pause(df).collect()}
    assert paused["1"] == ("paused", "Job paused: Frame 3") and paused["2"] == ("completed", "done")
    active = spark.createDataFrame([("3",), ("1",)], "job_id string")
    live = {r.job_id: r for r in jobs.recover_running(df, active).collect()}
    assert (live["3"].state, live["3"].phase, live["3"].percent) == ("running", "encoding", 99)
    assert live["1"].state == "paused" and live["2"].state == "paused"


def test_transparency_is_left_out(spark, tmp_path):
    """A frame with an alpha channel reads as three channels."""
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    pixels = bytes([10, 20, 30, 255, 40, 50, 60, 128])  # two pixels, RGBA
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x00" + pixels)) + chunk(b"IEND", b"")
    (tmp_path / "clip").mkdir()
    (tmp_path / "clip" / "frame_00001.png").write_bytes(png)
    row = readers.read_frames(spark, str(tmp_path)).first()
    assert (row.width, row.channels, bytes(row.pixels)) == (2, 3, bytes([30, 20, 10, 60, 50, 40]))
