"""Applying user model functions to frame tables.

The functions get and return lists of ``uint8`` arrays ``(height, width, channels)``. Spark partitions the work; a
group never holds more than one chunk of frames or the tiles of one frame.

Frames: ``keys, frame_index, width, height, channels, pixels`` (BINARY, row-major, interleaved).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, functions as F

from framelane.operators.completeness import output_completeness
from framelane.plans.segments import TEMPORAL_MIN_FRAMES, TEMPORAL_RADIUS
from framelane.plans.tiles import tile_plan

FRAME_COLUMNS = ("width", "height", "channels", "pixels")


def _schema(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def _frame_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return _schema(df, keys) + ", width int, height int, channels int, pixels binary"


def _decode(row):
    import numpy as np

    return np.frombuffer(row.pixels, dtype=np.uint8).reshape(int(row.height), int(row.width), int(row.channels))


def _encode(frame) -> tuple[int, int, int, bytes]:
    import numpy as np

    h, w, c = frame.shape
    return w, h, c, np.ascontiguousarray(frame, dtype=np.uint8).tobytes()


def _attach(pdf, keys, frames):
    import pandas as pd

    out = pd.DataFrame([_encode(f) for f in frames], columns=list(FRAME_COLUMNS))
    return pd.concat([pdf[list(keys)].reset_index(drop=True), out], axis=1)


def _with_model(fn: Callable, loader: Callable | None) -> Callable:
    """``fn`` itself, or ``fn`` with the loaded model as its first argument.

    A worker loads the model of an operator once and keeps it for its later tasks.
    """
    if loader is None:
        return fn
    token = uuid.uuid4().hex

    def call(inputs):
        return fn(_loaded(token, loader), inputs)

    return call


def _loaded(token: str, loader: Callable):
    """The model from the worker's own store; this package travels by value, so its globals do not outlive a task."""
    import sys
    from types import SimpleNamespace

    store = sys.modules.setdefault("framelane_worker_models", SimpleNamespace(models={})).models
    if token not in store:
        store[token] = loader()
    return store[token]


def apply_framewise(
    frames: DataFrame,
    fn: Callable,
    keys: Sequence[str] = ("source_id", "frame_index"),
    batch: int = 16,
    loader: Callable | None = None,
) -> DataFrame:
    """Apply ``fn(frames)`` (or ``fn(model, frames)`` with a ``loader``) to batches of independent frames.

    The model is loaded once per worker, when its first batch arrives.
    """
    fn = _with_model(fn, loader)

    def run(batches: Iterator):
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                inputs = [_decode(r) for r in part.itertuples(index=False)]
                outputs = fn(inputs)
                if len(outputs) != len(inputs):
                    raise ValueError(f"model returned {len(outputs)} frames for {len(inputs)}")
                yield _attach(part, keys, outputs)

    return frames.select(*keys, *FRAME_COLUMNS).mapInPandas(run, _frame_schema(frames, keys))


def apply_temporal(
    frames: DataFrame,
    fn: Callable,
    keys: Sequence[str] = ("source_id",),
    chunk: int = 32,
    radius: int = TEMPORAL_RADIUS,
    minimum: int = TEMPORAL_MIN_FRAMES,
    loader: Callable | None = None,
) -> DataFrame:
    """Apply ``fn(frames)`` (or ``fn(model, frames)`` with a ``loader``) to chunks of consecutive frames with ``radius`` frames of context on both sides.

    Boundary frames are repeated map-side for both chunks; short inputs are padded with the last frame and the result is
    trimmed to the chunk. With ``radius=0`` the chunks are plain blocks.
    """
    fn = _with_model(fn, loader)
    step = max(1, chunk)
    i = F.col("frame_index").cast("bigint")
    low = F.greatest(F.lit(0).cast("bigint"), F.floor((i - radius) / step).cast("bigint"))
    spread = frames.select(*keys, "frame_index", *FRAME_COLUMNS).withColumn(
        "_chunk", F.explode(F.sequence(low, F.floor((i + radius) / step).cast("bigint")))
    )

    def run(key, pdf):
        pdf = pdf.sort_values("frame_index")
        start = int(key[-1]) * step
        inside = ((pdf["frame_index"] >= start) & (pdf["frame_index"] < start + step)).to_numpy()
        if not inside.any():  # only context: the chunk begins after the last frame
            return _attach(pdf.iloc[:0], [*keys, "frame_index"], [])
        inputs = [_decode(r) for r in pdf.itertuples(index=False)]
        padded = inputs + [inputs[-1]] * max(0, minimum - len(inputs))
        outputs = fn(padded)[: len(inputs)]
        return _attach(pdf[inside], [*keys, "frame_index"], [o for o, k in zip(outputs, inside) if k])

    by = [*keys, "frame_index"]
    return spread.groupBy(*keys, "_chunk").applyInPandas(run, _frame_schema(frames, by))


SPOT = ("top", "left", "bottom", "right", "crop_top", "crop_left", "crop_bottom", "crop_right")


def _spots(plan) -> list[tuple[int, ...]]:
    """A plan column value as tuples in the order of ``SPOT``."""
    return [tuple(int(s[c]) for c in SPOT) for s in plan]


def _cut(frame, spots):
    """The tiles of a frame; a frame smaller than its padded plan is mirrored at the far edges."""
    import numpy as np

    down = max(0, max(s[2] for s in spots) - frame.shape[0])
    across = max(0, max(s[3] for s in spots) - frame.shape[1])
    if down or across:
        frame = np.pad(frame, ((0, down), (0, across), (0, 0)), mode="reflect")
    return [frame[top:bottom, left:right] for top, left, bottom, right, *_ in spots]


def _assemble(parts, spots, height: int, width: int, mode: str, scale: int):
    """Put processed tiles together: inner parts side by side, or the mean where tiles overlap."""
    import numpy as np

    channels = parts[0].shape[2]
    placed = [tuple(v * scale for v in s) for s in spots]
    if mode == "crop":
        out = np.zeros((height * scale, width * scale, channels), dtype=np.uint8)
        for part, (top, left, _, _, ct, cl, cb, cr) in zip(parts, placed):
            out[ct:cb, cl:cr] = part[ct - top : cb - top, cl - left : cr - left]
        return out
    extent = (max(s[2] for s in placed), max(s[3] for s in placed))
    total, cover = np.zeros((*extent, channels)), np.zeros((*extent, 1))
    for part, (top, left, bottom, right, *_) in zip(parts, placed):
        total[top:bottom, left:right] += part
        cover[top:bottom, left:right] += 1
    return np.clip(np.rint(total / cover), 0, 255).astype(np.uint8)[: height * scale, : width * scale]


def apply_tiled(
    frames: DataFrame,
    fn: Callable,
    tile: int,
    overlap: int = 0,
    mode: str = "crop",
    scale: int = 1,
    multiple: int = 1,
    keys: Sequence[str] = ("source_id", "frame_index"),
    batch: int = 16,
    spread: bool = False,
    loader: Callable | None = None,
) -> DataFrame:
    """Cut frames into tiles, apply ``fn(tiles)`` (or ``fn(model, tiles)`` with a ``loader``; results ``scale`` times larger) and put the frames together again.

    ``crop`` keeps the inner part of each tile, ``average`` divides the sum of overlapping results by their coverage.
    The tile plan is a column of the frame's own row, so planning needs no join. Normally a frame is cut, processed and
    assembled in its own task without a shuffle; ``spread`` sends the tiles of a frame to different tasks, for few but
    large frames.
    """
    fn = _with_model(fn, loader)
    planned = frames.select(
        *keys, *FRAME_COLUMNS, tile_plan(F.col("width"), F.col("height"), tile, overlap, mode, multiple).alias("plan")
    )
    result_schema = _frame_schema(frames, keys)
    if not spread:

        def whole(batches: Iterator):
            for pdf in batches:
                for n, r in enumerate(pdf.itertuples(index=False)):
                    spots = _spots(r.plan)
                    parts = _cut(_decode(r), spots)
                    done = []
                    for start in range(0, len(parts), batch):
                        done.extend(fn(parts[start : start + batch]))
                    yield _attach(
                        pdf.iloc[n : n + 1], keys, [_assemble(done, spots, int(r.height), int(r.width), mode, scale)]
                    )

        return planned.mapInPandas(whole, result_schema)

    places = ("tile_index", "frame_width", "frame_height", *SPOT)
    tile_schema = f"{_schema(frames, keys)}, " + ", ".join(f"{c} int" for c in places) + (
        ", width int, height int, channels int, pixels binary"
    )

    def scatter(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                spots = _spots(r.plan)
                base = tuple(getattr(r, k) for k in keys)
                for n, (spot, part) in enumerate(zip(spots, _cut(_decode(r), spots))):
                    rows.append((*base, n, int(r.width), int(r.height), *spot, *_encode(part)))
            yield pd.DataFrame(rows, columns=[*keys, *places, *FRAME_COLUMNS])

    tiles = planned.mapInPandas(scatter, tile_schema).repartition(*keys, "tile_index")
    done = apply_framewise(tiles, fn, [*keys, *places], batch)
    # one row per frame; its list is as long as the frame has tiles
    collected = done.groupBy(*keys, "frame_width", "frame_height").agg(
        F.collect_list(F.struct(*SPOT, *FRAME_COLUMNS)).alias("parts")
    )

    def gather(batches: Iterator):
        import numpy as np

        for pdf in batches:
            for n, r in enumerate(pdf.itertuples(index=False)):
                parts = [
                    np.frombuffer(p["pixels"], dtype=np.uint8).reshape(p["height"], p["width"], p["channels"])
                    for p in r.parts
                ]
                frame = _assemble(parts, _spots(r.parts), int(r.frame_height), int(r.frame_width), mode, scale)
                yield _attach(pdf.iloc[n : n + 1], keys, [frame])

    return collected.mapInPandas(gather, result_schema)


def run_stages(
    frames: DataFrame,
    stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame] | None]],
    keys: Sequence[str] = ("source_id",),
    folder: str | None = None,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Run optional table transforms in order (denoise, colorize, upscale, interpolate).

    With a ``folder`` (shared by all machines) each stage's frames are written there once, as ``folder/stage``, and the next stage and the
    reports read what was written; without one everything stays lazy, and each action runs the stages anew.

    A stage given as None is left out of the plan. Returns the result and, per stage, its completeness table; the
    interpolate stage changes the number of frames, so there only the counts are meaningful.
    """
    reports: dict[str, DataFrame] = {}
    current = frames
    for name, transform in stages:
        if transform is None:
            continue
        result = transform(current)
        if folder is not None:
            result.write.parquet(f"{folder}/{name}")
            result = result.sparkSession.read.parquet(f"{folder}/{name}")
        reports[name] = output_completeness(current, result, keys)
        current = result
    return current, reports


def frame_profile(frames: DataFrame, keys: Sequence[str] = ("source_id", "frame_index")) -> DataFrame:
    """Mean luma and the row and column edge profiles (mean absolute step between neighbouring lines)."""
    schema = _schema(frames, keys) + ", mean_luma double, row_profile array<double>, col_profile array<double>"

    def run(batches: Iterator):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                gray = _gray(_decode(r))
                rows.append(
                    (
                        float(gray.mean()),
                        np.abs(np.diff(gray, axis=0)).mean(axis=1).tolist(),
                        np.abs(np.diff(gray, axis=1)).mean(axis=0).tolist(),
                    )
                )
            measured = pd.DataFrame(rows, columns=["mean_luma", "row_profile", "col_profile"])
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), measured], axis=1)

    return frames.select(*keys, *FRAME_COLUMNS).mapInPandas(run, schema)


def _gray(frame):
    """Luma of a BGR frame (a single channel is its own luma)."""
    values = frame.astype(float)
    if values.shape[2] == 1:
        return values[:, :, 0]
    return values[:, :, 0] * 0.114 + values[:, :, 1] * 0.587 + values[:, :, 2] * 0.299


# Caption detection settings.
CAPTION_SETTINGS = {
    "bottom_region_fraction": 0.42,
    "light_threshold": 185,
    "color_saturation_threshold": 80,
    "color_value_threshold": 130,
    "color_hue_min": 18,
    "color_hue_max": 95,
    "edge_threshold": 50,
}


def detect_caption_components(
    frames: DataFrame, keys: Sequence[str] = ("clip_id", "frame_index"), **settings
) -> DataFrame:
    """Connected components of likely caption pixels in the bottom region of each frame.

    A pixel is a candidate when it is light, or strongly coloured in the caption hues next to an edge. The result feeds
    :mod:`framelane.operators.captions`. Edges are a gradient threshold.
    """
    chosen = {**CAPTION_SETTINGS, **settings}
    schema = _schema(frames, keys) + (
        ", component_id int, x int, y int, width int, height int, area int, center_y double, roi_width int, roi_height int"
    )
    names = ("component_id", "x", "y", "width", "height", "area", "center_y", "roi_width", "roi_height")

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                frame = _decode(r)
                share = min(0.95, max(0.05, chosen["bottom_region_fraction"]))
                top = max(0, min(frame.shape[0] - 1, round(frame.shape[0] * (1.0 - share))))
                region = frame[top:]
                base = tuple(getattr(r, k) for k in keys)
                for n, part in enumerate(_components(_caption_mask(region, chosen)), start=1):
                    rows.append((*base, n, *part, region.shape[1], region.shape[0]))
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return frames.select(*keys, *FRAME_COLUMNS).mapInPandas(run, schema)


def _caption_mask(region, chosen):
    import numpy as np

    gray = _gray(region)
    light = np.rint(gray) >= chosen["light_threshold"]
    if region.shape[2] == 1:
        return light
    step = np.hypot(*np.gradient(gray)) >= chosen["edge_threshold"] if min(gray.shape) > 1 else np.zeros(gray.shape, bool)
    wide = np.pad(step, 1)  # nothing beyond the borders
    rows, cols = step.shape
    near = np.any([wide[y : y + rows, x : x + cols] for y in range(3) for x in range(3)], axis=0)
    return light | (_colored(region, chosen) & near)


def _colored(region, chosen):
    """Pixels of the caption colours in a BGR region."""
    import numpy as np

    b, g, r = (region[:, :, k].astype(float) for k in range(3))
    high, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    spread = high - low
    safe = np.where(spread > 0, spread, 1.0)
    saturation = np.where(high > 0, 255.0 * spread / np.where(high > 0, high, 1.0), 0.0)
    hue = np.where(high == r, (g - b) / safe, np.where(high == g, 2.0 + (b - r) / safe, 4.0 + (r - g) / safe))
    hue = np.where(spread > 0, (hue * 30.0) % 180.0, 0.0)
    return (
        (saturation >= chosen["color_saturation_threshold"])
        & (high >= chosen["color_value_threshold"])
        & (hue >= chosen["color_hue_min"])
        & (hue <= chosen["color_hue_max"])
    )


def _components(mask) -> list[tuple]:
    """8-connected components as ``x, y, width, height, area, center_y``, by joining the runs of neighbouring rows."""
    import numpy as np

    runs, parent, above = [], [], []

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for y in range(mask.shape[0]):
        edges = np.flatnonzero(np.diff(np.r_[0, mask[y].astype(np.int8), 0]))
        here, k = [], 0
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            label = len(parent)
            parent.append(label)
            runs.append((y, start, end))
            while k < len(above) and above[k][1] < start:  # ends before this run and all later ones
                k += 1
            at = k
            while at < len(above) and above[at][0] <= end:
                a, b = find(label), find(above[at][2])
                parent[max(a, b)] = min(a, b)
                at += 1
            here.append((start, end, label))
        above = here
    groups: dict[int, list] = {}
    for label, run in enumerate(runs):
        groups.setdefault(find(label), []).append(run)
    out = []
    for _, parts in sorted(groups.items()):
        ys, starts, ends = (np.array(v) for v in zip(*parts))
        size = ends - starts
        area = int(size.sum())
        out.append(
            (
                int(starts.min()), int(ys.min()), int(ends.max() - starts.min()), int(ys.max() - ys.min() + 1), area,
                float((ys * size).sum() / area),
            )
        )
    return out
