"""Metrics of frames from tiles against metrics of whole frames."""

import numpy as np
import pytest

from framelane.operators import quality, tiled_metrics

COLUMNS = ("mean_absolute_error", "root_mean_squared_error", "max_absolute_error", "psnr", "ssim")


def cut(image, rows, cols):
    """Tiles of an image at the given edges."""
    edges = lambda inner, size: list(zip([0, *inner], [*inner, size]))
    return [image[a:b, c:d] for a, b in edges(rows, image.shape[0]) for c, d in edges(cols, image.shape[1])]


def metrics(df):
    return {(r.source_id, r.frame_index): [r[c] for c in COLUMNS] for r in df.collect()}


@pytest.mark.parametrize("channels", [1, 3])
def test_every_tiling_gives_the_metrics_of_the_whole(spark, channels):
    rng = np.random.default_rng(channels)
    whole, tiled, arrays = [], [], []
    for k in range(8):
        h, w = int(rng.integers(1, 40)), int(rng.integers(1, 40))
        a = rng.integers(0, 256, (h, w, channels)).astype(np.uint8)
        b = a.copy() if k == 0 else np.clip(a + rng.integers(-40, 41, a.shape), 0, 255).astype(np.uint8)
        whole.append(("s", k, a.tobytes(), b.tobytes(), channels))
        rows, cols = (sorted(set(rng.integers(0, n + 1, rng.integers(0, 5)).tolist())) for n in (h, w))
        for x, y in zip(cut(a, rows, cols), cut(b, rows, cols)):
            tiled.append(("s", k, x.tobytes(), y.tobytes(), channels))
            arrays.append(("s", k, x.ravel().astype(float).tolist(), y.ravel().astype(float).tolist(), 9))
    names = "source_id string, frame_index long, reference {0}, candidate {0}, channels int"
    want = metrics(quality.binary_frame_metrics(spark.createDataFrame(whole, names.format("binary"))))
    tiles = spark.createDataFrame(tiled, names.format("binary")).repartition(5)
    got = metrics(tiled_metrics.merge_metrics(tiled_metrics.binary_tile_moments(tiles)))
    parts = tiled_metrics.tile_moments(spark.createDataFrame(arrays, names.format("array<double>")).repartition(5), channels=channels)
    again = metrics(tiled_metrics.merge_metrics(tiled_metrics.add_moments(parts)))  # sums of sums
    assert set(want) == set(got) == set(again) and want[("s", 0)][3] == float("inf")
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=2e-6) and again[key] == pytest.approx(values, abs=2e-6)


def test_empty_tiles(spark):
    names = "source_id string, frame_index long, reference binary, candidate binary, channels int"
    df = spark.createDataFrame([("s", 0, b"", b"", 3), ("s", 1, b"", b"", 3), ("s", 1, b"abc", b"abd", 3)], names)
    assert list(metrics(tiled_metrics.merge_metrics(tiled_metrics.binary_tile_moments(df)))) == [("s", 1)]
    assert tiled_metrics.merge_metrics(tiled_metrics.binary_tile_moments(df.limit(0))).count() == 0
