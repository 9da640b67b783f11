"""Model application: identity in must be identity out, halos must be right."""

import numpy as np
import pytest
from images import FRAMES, as_arrays, frame_rows

from framelane.operators import apply, captions


def clip(spark, count=11, shape=(37, 53, 3), seed=3):
    rng = np.random.default_rng(seed)
    frames = [rng.integers(0, 256, shape) for _ in range(count)]
    return frames, spark.createDataFrame(frame_rows(frames), FRAMES)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert np.array_equal(a, b)


def test_framewise_loads_lazily(spark):
    frames, df = clip(spark)
    out = apply.apply_framewise(df, lambda model, fs: [np.clip(f.astype(int) + model, 0, 255) for f in fs], batch=3, loader=lambda: 5)
    same(as_arrays(out), [np.clip(f + 5, 0, 255) for f in frames])


def test_loader_runs_once_per_worker(spark, tmp_path):
    """One load per Python worker and operator, over many tasks, chunks and tiles."""
    frames, df = clip(spark, 24, (16, 16, 1))

    def loader():
        import os

        with open(tmp_path / "loads", "a") as log:
            log.write(f"{os.getpid()}\n")
        return 3

    def add(model, parts):
        return [np.clip(p.astype(int) + model, 0, 255).astype(np.uint8) for p in parts]

    spread = df.repartition(6)
    for out in (
        apply.apply_framewise(spread, add, batch=2, loader=loader),
        apply.apply_temporal(spread, add, chunk=3, radius=0, minimum=1, loader=loader),
        apply.apply_tiled(spread, add, 8, loader=loader),
    ):
        (tmp_path / "loads").write_text("")
        same(as_arrays(out), [np.clip(f.astype(int) + 3, 0, 255) for f in frames])
        loads = (tmp_path / "loads").read_text().split()
        assert loads and len(loads) == len(set(loads))


@pytest.mark.parametrize("chunk, radius, count", [(4, 2, 11), (4, 0, 11), (32, 2, 3), (5, 2, 10), (1, 3, 6)])
def test_temporal_window(spark, chunk, radius, count):
    frames, df = clip(spark, count, (6, 5, 1))

    def mean_of_neighbours(fs):
        stack = np.stack([f.astype(float) for f in fs])
        return [
            np.rint(stack[max(0, i - radius) : i + radius + 1].mean(axis=0)).astype(np.uint8) for i in range(len(fs))
        ]

    out = apply.apply_temporal(df, mean_of_neighbours, chunk=chunk, radius=radius, minimum=1)
    want = mean_of_neighbours(frames)
    if radius == 0:
        want = [np.asarray(f, dtype=np.uint8) for f in frames]
    same(as_arrays(out), want)


def test_temporal_pads_short_clips(spark):
    frames, df = clip(spark, 2, (4, 4, 1))

    def needs_five(fs):
        assert len(fs) >= 5
        return fs

    same(as_arrays(apply.apply_temporal(df, needs_five)), frames)


@pytest.mark.parametrize("tile, overlap, mode, multiple", [
    (16, 0, "crop", 1), (20, 0, "crop", 1), (64, 0, "crop", 1), (0, 0, "crop", 1),
    (16, 4, "average", 8), (24, 8, "average", 8), (17, 3, "average", 1), (64, 4, "average", 8),
])
@pytest.mark.parametrize("spread", [False, True])
def test_tiled_identity(spark, tile, overlap, mode, multiple, spread):
    frames, df = clip(spark, 3)
    out = apply.apply_tiled(df, lambda ts: ts, tile, overlap, mode, multiple=multiple, spread=spread)
    same(as_arrays(out), frames)


def test_tiled_upscale(spark):
    frames, df = clip(spark, 2)
    double = lambda ts: [t.repeat(2, axis=0).repeat(2, axis=1) for t in ts]
    for mode in ("crop", "average"):
        out = apply.apply_tiled(df, double, 16, 4, mode, scale=2)
        same(as_arrays(out), [f.repeat(2, axis=0).repeat(2, axis=1) for f in frames])


def test_stages(spark):
    frames, df = clip(spark, 4, (8, 8, 1))
    out, reports = apply.run_stages(
        df,
        [
            ("denoise", lambda d: apply.apply_temporal(d, lambda fs: fs)),
            ("colorize", None),
            ("upscale", lambda d: apply.apply_framewise(d, lambda fs: [f.repeat(2, axis=0).repeat(2, axis=1) for f in fs])),
        ],
    )
    same(as_arrays(out), [f.repeat(2, axis=0).repeat(2, axis=1) for f in frames])
    assert list(reports) == ["denoise", "upscale"]
    assert all(r.complete for report in reports.values() for r in report.collect())


def test_written_stages_run_once(spark, tmp_path):
    """Reports and result read what was written, so the model sees every frame once."""
    frames, df = clip(spark, 6, (8, 8, 1))
    seen = spark.sparkContext.accumulator(0)

    def count(fs):
        seen.add(len(fs))
        return fs

    out, reports = apply.run_stages(
        df, [("denoise", lambda d: apply.apply_framewise(d, count)), ("upscale", lambda d: apply.apply_framewise(d, count))], folder=str(tmp_path / "stages")
    )
    same(as_arrays(out), frames)
    assert all(r.complete for report in reports.values() for r in report.collect()) and seen.value == 12


def test_caption_components(spark):
    frame = np.full((120, 200, 3), 30)
    frame[100:108, 40:46] = 240
    frame[100:108, 50:58] = 240
    frame[104:106, 46:50] = 240  # a bar joins the two
    frame[100:108, 90:99] = 240
    frame[5:9, 5:9] = 240  # above the caption region
    rows = frame_rows([frame])
    df = spark.createDataFrame([("c", *r[1:]) for r in rows], FRAMES.replace("source_id", "clip_id"))
    got = apply.detect_caption_components(df).orderBy("x").collect()
    assert [(r.x, r.width, r.height, r.area) for r in got] == [(40, 18, 8, 120), (90, 9, 8, 72)]
    assert got[0].roi_width == 200 and got[0].roi_height == 120 - round(120 * 0.58)
    assert captions.size_gate(apply.detect_caption_components(df)).count() == 2


def test_components_match_flood_fill():
    rng = np.random.default_rng(2)
    for _ in range(20):
        mask = rng.random((18, 23)) > 0.6
        seen, found = np.zeros_like(mask), []
        for y, x in zip(*np.nonzero(mask)):
            if seen[y, x]:
                continue
            stack, cells = [(y, x)], []
            seen[y, x] = True
            while stack:
                cy, cx = stack.pop()
                cells.append((cy, cx))
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        ny, nx = cy + dy, cx + dx
                        if 0 <= ny < 18 and 0 <= nx < 23 and mask[ny, nx] and not seen[ny, nx]:
                            seen[ny, nx] = True
                            stack.append((ny, nx))
            ys, xs = [c[0] for c in cells], [c[1] for c in cells]
            found.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells), float(np.mean(ys))))
        got = apply._components(mask)
        assert sorted(g[:5] for g in got) == sorted(f[:5] for f in found)
        assert sorted(g[5] for g in got) == pytest.approx(sorted(f[5] for f in found))


def test_edge_at_the_border_marks_no_far_pixels():
    """Colour near an edge counts; the far border is not near."""
    region = np.zeros((12, 40, 3), dtype=np.uint8)
    region[:, :, 0], region[:, :, 1] = 200, 40  # coloured all over
    region[:, 39] = 0
    chosen = dict(light_threshold=256, edge_threshold=20, color_saturation_threshold=40, color_value_threshold=60, color_hue_min=0, color_hue_max=180)
    columns = np.flatnonzero(apply._caption_mask(region, chosen).any(axis=0))
    assert len(columns) and columns.min() >= 36
