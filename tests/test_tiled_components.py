"""Caption components from tiles against pixel-by-pixel rules over whole frames."""

import numpy as np
import pytest

from framelane.operators import apply
from framelane.operators import tiled_components as tc

TILES = "source_id string, frame_index int, frame_width int, frame_height int, x int, y int, width int, height int, channels int, pixels binary"
SETTINGS = dict(light_threshold=235, color_saturation_threshold=60, color_value_threshold=90, color_hue_min=10, color_hue_max=120, bottom_region_fraction=0.7)


def cut(image, size, frame=0, source="s"):
    h, w, c = image.shape
    return [
        (source, frame, w, h, x, y, min(size, w - x), min(size, h - y), c, bytearray(np.ascontiguousarray(image[y : y + size, x : x + size]).tobytes()))
        for y in range(0, h, size)
        for x in range(0, w, size)
    ]


def plain_edges(gray, low, high):
    """Gradients, thinning and hysteresis, pixel by pixel."""
    h, w = gray.shape
    at = lambda y, x: int(gray[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    grad = {}
    for y in range(h):
        for x in range(w):
            gx = sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            grad[y, x] = (gx, gy)
    size = lambda y, x: sum(map(abs, grad.get((y, x), (0, 0))))
    weak = set()
    for (y, x), (gx, gy) in grad.items():
        m, slope = size(y, x), tc.TAN_22 / 2**15
        if abs(gy) < abs(gx) * slope:
            top = m > size(y, x - 1) and m >= size(y, x + 1)
        elif abs(gy) > abs(gx) * (slope + 2):
            top = m > size(y - 1, x) and m >= size(y + 1, x)
        else:
            s = 1 if (gx < 0) == (gy < 0) else -1
            top = m > size(y - 1, x - s) and m > size(y + 1, x + s)
        if top and m > low:
            weak.add((y, x))
    out = np.zeros((h, w), bool)
    stack = [p for p in weak if size(*p) > high]
    while stack:
        y, x = stack.pop()
        if out[y, x]:
            continue
        out[y, x] = True
        stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (y + a, x + b) in weak]
    return out


def plain_components(image, low=50, high=150):
    chosen = {**apply.CAPTION_SETTINGS, **SETTINGS}
    h = image.shape[0]
    region = image[max(0, min(h - 1, round(h * (1.0 - chosen["bottom_region_fraction"])))) :]
    gray = np.rint(apply._gray(region)).astype(int)
    light, (rows, cols) = gray >= chosen["light_threshold"], gray.shape
    mask = light.copy()
    if region.shape[2] == 3:
        edges, color = plain_edges(gray, low, high), apply._colored(region, chosen)
        for y in range(rows):
            for x in range(cols):
                mask[y, x] |= color[y, x] and edges[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any()
    kept = np.zeros_like(mask)
    for y in range(rows - 1):
        for x in range(cols - 1):
            if mask[y : y + 2, x : x + 2].all():
                kept[y : y + 2, x : x + 2] = True
    return [(n, *part, cols, rows) for n, part in enumerate(apply._components(kept), start=1)]


def blobs(rng, h, w, channels=3):
    """Noise over smooth colours, bright bars across many tiles and faint edges that hang on strong ones."""
    y, x = np.mgrid[:h, :w]
    image = np.stack([90 + 60 * np.sin((x + k * 9) / 7) * np.cos(y / 5) for k in range(channels)], axis=2) + rng.normal(0, 14, (h, w, channels))
    image[:, :, -1] += 40
    image[h // 2 : h // 2 + 2, 3 : w - 3] = 250
    image[h // 2 :, w // 2 : w // 2 + 3] = 250
    image[h // 3 : h // 3 + 6, w // 4 : w // 4 + 9] = rng.integers(0, 256, (6, 9, channels))[: max(0, min(6, h - h // 3)), : max(0, min(9, w - w // 4))]
    return np.clip(image, 0, 255).astype(np.uint8)


def found(df):
    rows = {}
    for r in df.collect():
        rows.setdefault((r.source_id, r.frame_index), []).append(tuple(r)[2:])
    return {k: sorted(v) for k, v in rows.items()}


@pytest.mark.parametrize("tile,cell", [(11, 7), (1, 16), (16, 1)])
def test_every_tiling_gives_the_components_of_the_whole(spark, tile, cell):
    rng = np.random.default_rng(4)
    images = [blobs(rng, 40, 36), blobs(rng, 31, 45), blobs(rng, 24, 24, 1)] if cell > 1 else [blobs(rng, 16, 18)]
    rows = [t for k, image in enumerate(images) for t in cut(image, tile, k)]
    got = found(tc.detect_tiled_components(spark.createDataFrame(rows[::-1] + rows[:1], TILES).repartition(6), cell=cell, **SETTINGS))
    want = {("s", k): plain_components(image) for k, image in enumerate(images)}
    assert set(got) == {k for k, v in want.items() if v} and any(len(v) > 3 for v in want.values())
    for key, parts in got.items():
        assert [p[:6] + p[7:] for p in parts] == [p[:6] + p[7:] for p in want[key]]
        assert [p[6] for p in parts] == pytest.approx([p[6] for p in want[key]])


def test_edges_need_a_strong_pixel_of_their_own_line(spark):
    """A faint step counts where it hangs on a strong one, however many cells away; the same step alone does not."""
    image = np.full((30, 60, 3), 100, np.uint8)
    image[:20] = (40, 118, 140)
    alone = image.copy()
    image[:20, 55:] = (0, 250, 250)
    gray = np.rint(apply._gray(image)).astype(int)
    weak, strong = tc.edge_classes(gray)
    assert weak[18:21, 2:50].any() and not strong[:, :50].any() and strong[:, 50:].any()
    chosen = {**SETTINGS, "light_threshold": 256, "bottom_region_fraction": 0.95, "color_hue_min": 0}
    rows = cut(image, 8, 0) + cut(alone, 8, 1)
    got = found(tc.detect_tiled_components(spark.createDataFrame(rows, TILES), cell=6, **chosen))
    assert set(got) == {("s", 0)} and any(p[1] == 0 and p[3] > 45 for p in got["s", 0]), got


def test_labels_of_random_masks():
    rng = np.random.default_rng(3)
    for density in (0.0, 0.3, 0.5, 0.7, 1.0):
        mask = rng.random((23, 31)) < density
        labels = tc.labelled(mask)
        assert ((labels < 0) == ~mask).all()
        assert len(np.unique(labels[mask])) == len(apply._components(mask))
        for label in np.unique(labels[mask]):
            assert np.flatnonzero(labels.ravel() == label)[0] == label


def test_odd_tiles(spark):
    """Nulls, empty and missing tiles and empty tables: such tiles are black; extra columns are not read."""
    image = np.full((20, 20, 1), 250, np.uint8)
    rows = cut(image, 10)
    rows[3] = (*rows[3][:9], None)
    rows += [(None, *rows[0][1:]), ("s", 1, 20, 20, 0, 0, 0, 0, 1, bytearray())]
    df = spark.createDataFrame(rows, TILES)
    got = found(tc.detect_tiled_components(df.selectExpr("*", "1 AS label", "2 AS root", "3 AS _rn"), cell=4))
    top = round(20 * 0.58)
    # below the top of the region only the left tile is there: a 10 wide block
    assert got == {("s", 0): [(1, 0, 0, 10, 20 - top, 10 * (20 - top), (20 - top - 1) / 2, 20, 20 - top)]}
    assert tc.detect_tiled_components(df.limit(0), cell=4).count() == 0
