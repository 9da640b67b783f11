"""Frame metrics, masks and seams against numpy."""

import numpy as np
import pytest
from images import FRAMES, frame_rows

from framelane.operators import apply, quality


def test_identical_frames(spark):
    df = spark.createDataFrame([([127.0] * 64, [127.0] * 64)], "reference array<double>, candidate array<double>")
    got = quality.frame_metrics(df).first()
    assert (got.mean_absolute_error, got.max_absolute_error, got.ssim, got.psnr) == (0.0, 0.0, 1.0, float("inf"))
    summary = quality.summarize_frame_metrics(quality.frame_metrics(df)).first()
    assert summary.average_psnr == float("inf")


def test_summary(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 3.0, 40.0, 0.9), (2.0, 2.0, 5.0, 38.0, 0.8)],
        "mean_absolute_error double, root_mean_squared_error double, max_absolute_error double, psnr double, ssim double",
    )
    got = quality.summarize_frame_metrics(df).first()
    assert (got.average_mean_absolute_error, got.max_absolute_error, got.average_psnr) == (1.5, 5.0, 39.0)
    assert quality.summarize_frame_metrics(df.limit(0)).count() == 0


@pytest.mark.parametrize("channels", [1, 3])
def test_array_and_binary_metrics_agree(spark, channels):
    rng = np.random.default_rng(channels)
    a = [rng.integers(0, 256, (9, 7, channels)) for _ in range(5)]
    b = [np.clip(f + rng.integers(-20, 20, f.shape), 0, 255) for f in a]
    ref = spark.createDataFrame(frame_rows(a), FRAMES)
    cand = spark.createDataFrame(frame_rows(b), FRAMES)
    pairs, rejects = quality.pair_frames(ref, cand, shape=("width", "height", "channels"))
    assert rejects.count() == 0
    binary = {r.frame_index: r for r in quality.binary_frame_metrics(pairs).collect()}
    arrays = spark.createDataFrame(
        [(i, x.ravel().astype(float).tolist(), y.ravel().astype(float).tolist()) for i, (x, y) in enumerate(zip(a, b))],
        "frame_index int, reference array<double>, candidate array<double>",
    )
    for r in quality.frame_metrics(arrays, channels=channels).collect():
        for c in quality.METRIC_COLUMNS:
            assert binary[r.frame_index][c] == pytest.approx(r[c], abs=2e-6)


def test_pair_rejects(spark):
    schema = "source_id string, frame_index int, pixels array<double>"
    ref = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [1.0]), ("a", 2, [1.0])], schema)
    cand = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 2, [3.0]), ("a", 3, [1.0])], schema)
    pairs, rejects = quality.pair_frames(ref, cand)
    assert [r.frame_index for r in pairs.collect()] == [2]
    assert {(r.frame_index, r.reason) for r in rejects.collect()} == {
        (0, "missing candidate"),
        (1, "shape mismatch"),
        (3, "missing reference"),
    }


def test_smoothing_radius_one(spark):
    masks = spark.createDataFrame(
        [("c", 0, [1, 0, 0, 0]), ("c", 1, [0, 1, 0, 0]), ("c", 2, [0, 0, 0, 0]), ("c", 3, [0, 0, 0, 1])],
        "source_id string, frame_index int, mask array<int>",
    )
    got = {r.frame_index: list(r["mask"]) for r in quality.smooth_masks(masks, 1).collect()}
    assert got == {0: [1, 1, 0, 0], 1: [1, 1, 0, 0], 2: [0, 1, 0, 1], 3: [0, 0, 0, 1]}


def test_flicker_random(spark):
    rng = np.random.default_rng(5)
    frames = rng.random((40, 12))
    masks = (rng.random((40, 12)) > 0.9).astype(int)
    df = spark.createDataFrame(
        [("c", i, frames[i].tolist(), masks[i].tolist()) for i in range(40)],
        "source_id string, frame_index int, pixels array<double>, mask array<int>",
    )
    values = []
    for i in range(1, 40):
        union = (masks[i] | masks[i - 1]) > 0
        if union.any():
            values.append(np.abs(frames[i] - frames[i - 1])[union].mean())
    assert quality.masked_flicker(df).first().masked_flicker == pytest.approx(np.mean(values))


def seams(spark, gray):
    frame = np.repeat(gray[:, :, None], 3, axis=2)
    profiles = apply.frame_profile(spark.createDataFrame(frame_rows([frame]), FRAMES))
    return [r["labels"] for r in quality.find_tile_seams(profiles).collect()]


def test_seams_found_in_blocks_not_in_ramp(spark):
    blocks = np.zeros((180, 320))
    for (y, x), v in zip([(y, x) for y in (0, 90) for x in (0, 107, 214)], (40, 180, 150, 70, 210, 30)):
        blocks[y : y + 90, x : x + 107] = v
    blocks[:, 214:] = np.where(np.arange(180)[:, None] < 60, 150, np.where(np.arange(180)[:, None] < 120, 70, 210))
    found = seams(spark, blocks)
    assert found and any(v.startswith("row") for v in found[0]) and any(v.startswith("col") for v in found[0])
    assert seams(spark, np.tile(np.linspace(0, 255, 320), (180, 1))) == []


def slow_peaks(values):
    """Straightforward reading of the rule, for comparison."""
    candidates = []
    n = len(values)
    for i in range(8, max(8, n - 8)):
        if values[i] < values[i - 1] or values[i] < values[i + 1]:
            continue
        near = [values[j] for j in range(max(0, i - 8), min(n, i + 9)) if abs(j - i) > 2]
        middle = float(np.median(near))
        ratio = values[i] / max(1.0, middle)
        if values[i] >= 8 and ratio >= 2.8 and values[i] - middle >= 6:
            candidates.append((values[i], i, ratio))
    kept = []
    for value, i, ratio in sorted(candidates, reverse=True):
        if len(kept) < 4 and all(abs(i - k) >= 12 for k, _ in kept):
            kept.append((i, ratio))
    return sorted(kept)


def test_seam_peaks_match_slow_form():
    rng = np.random.default_rng(0)
    for _ in range(50):
        values = np.round(rng.exponential(3.0, 90)) + (rng.random(90) > 0.92) * rng.integers(5, 40, 90)
        got, want = quality._seam_peaks(values), slow_peaks(list(values))
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [r for _, r in got] == pytest.approx([r for _, r in want])


def test_local_scores_at_the_edges(spark):
    rng = np.random.default_rng(1)
    values = (rng.random(30) * 20).tolist()
    got = quality.local_seam_scores(spark.createDataFrame([(1, values)], "id int, profile array<double>"))
    for r in got.collect():
        near = [values[j] for j in range(max(0, r.position - 8), min(30, r.position + 9)) if abs(j - r.position) > 2]
        assert r.local_median == pytest.approx(np.median(near))
        assert r.ratio == pytest.approx(values[r.position] / max(1.0, np.median(near)))


def test_profile_luma(spark):
    frame = np.full((4, 5, 3), 80)
    out = apply.frame_profile(spark.createDataFrame(frame_rows([frame]), FRAMES)).first()
    assert out.mean_luma == pytest.approx(80.0)
    assert len(out.row_profile) == 3 and len(out.col_profile) == 4


def test_scorecard_missing_tool(spark):
    base = spark.createDataFrame([("s1", "a", 1.0), ("s1", "b", 2.0), ("s2", "a", 3.0)], "sample_id string, tool string, seconds double")
    loose = quality.tools_by_sample(base, ("a", "b"), "a")
    assert {(r.sample_id, r.tool, r.missing) for r in loose.collect()} == {
        ("s1", "a", False), ("s1", "b", False), ("s2", "a", False), ("s2", "b", True),
    }
    assert quality.tools_by_sample(base, ("a", "b"), "a", strict=True).count() == 3


def test_mask_bbox_empty_is_whole_frame(spark):
    frames = spark.createDataFrame([("c", 0, 100, 50), ("c", 1, 100, 50)], "source_id string, frame_index int, width int, height int")
    pixels = spark.createDataFrame([("c", 1, 40, 20), ("c", 1, 60, 25)], "source_id string, frame_index int, x int, y int")
    got = {r.frame_index: tuple(r)[2:] for r in quality.mask_bbox(pixels, frames).orderBy("frame_index").collect()}
    assert got == {0: (0, 0, 100, 50), 1: (12, 0, 89, 50)}
