"""Caption components of frames that are too large for a task.

A frame comes as disjoint tiles of any sizes. Its caption region is cut anew into square cells, each read with a margin of two pixels. Two
questions reach beyond every margin: which weak edge pixels hang together with a strong one (edges with hysteresis), and which mask pixels
form a component. Both are answered in two passes: every cell labels its own pixels, then labels that touch across cell borders are joined by
Spark. A label is the position of its first pixel in reading order, so results do not depend on tiles, cells or partitions. No task holds
more than a cell with its margin, and only border pixels and labels are joined.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from framelane.operators.apply import CAPTION_SETTINGS, _colored, _gray, _schema
from framelane.operators.ordered import blocked_row_number, index_block
from framelane.session import ensure_checkpoint_dir

FRAME = ("source_id", "frame_index")
MARGIN = 2
# Edge thresholds of the caption mask, and tan(22.5 degrees) in 15 bits.
EDGE_LOW, EDGE_HIGH = 50, 150
TAN_22 = 13573
#: Bits of a pixel between the passes.
LIGHT, COLORED, WEAK, STRONG, EDGE = 1, 2, 4, 8, 16

_CELL = ", cell_row long, cell_col long, part_y long, part_x long, part_h int, part_w int, roi_rows long, roi_cols long, part_n int, part_values binary"
_PART = ", cell_row long, cell_col long, label long, x long, y long, right long, bottom long, area long, sum_y double, marked boolean, own array<long>, ahead array<long>"


def _saved(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared checkpoint folder and read from there."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/cells-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread_cells(blocks: DataFrame, keys: Sequence[str], cell: int) -> DataFrame:
    """Sends every part of ``part_values`` to the cells that see it, their margins included."""

    def send(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                block = np.frombuffer(r.part_values, np.uint8).reshape(r.part_h, r.part_w, r.part_n)
                for row in range(max(0, (r.part_y - MARGIN) // cell), (min(r.roi_rows, r.part_y + r.part_h + MARGIN) - 1) // cell + 1):
                    top, bottom = max(r.part_y, row * cell - MARGIN), min(r.part_y + r.part_h, (row + 1) * cell + MARGIN, r.roi_rows)
                    for col in range(max(0, (r.part_x - MARGIN) // cell), (min(r.roi_cols, r.part_x + r.part_w + MARGIN) - 1) // cell + 1):
                        left, right = max(r.part_x, col * cell - MARGIN), min(r.part_x + r.part_w, (col + 1) * cell + MARGIN, r.roi_cols)
                        if top < bottom and left < right:
                            part = np.ascontiguousarray(block[top - r.part_y : bottom - r.part_y, left - r.part_x : right - r.part_x])
                            place = (row, col, top, left, bottom - top, right - left, r.roi_rows, r.roi_cols, r.part_n, part.tobytes())
                            rows.append((*(getattr(r, k) for k in keys), *place))
            yield pd.DataFrame(rows, columns=[*keys, "cell_row", "cell_col", "part_y", "part_x", "part_h", "part_w", "roi_rows", "roi_cols", "part_n", "part_values"])

    return blocks.mapInPandas(send, _schema(blocks, keys) + _CELL)


def _assembled(pdf: pd.DataFrame, cell: int):
    """One cell with its margin: values, which of them are there, and the cell's own part as slices; positions count from the region's corner."""
    first = pdf.iloc[0]
    y, x = int(first["cell_row"]) * cell, int(first["cell_col"]) * cell
    low_y, low_x = max(0, y - MARGIN), max(0, x - MARGIN)
    high_y, high_x = min(int(first["roi_rows"]), y + cell + MARGIN), min(int(first["roi_cols"]), x + cell + MARGIN)
    values = np.zeros((high_y - low_y, high_x - low_x, int(first["part_n"])), np.uint8)
    there = np.zeros(values.shape[:2], bool)
    for r in pdf.itertuples(index=False):
        spot = slice(r.part_y - low_y, r.part_y - low_y + r.part_h), slice(r.part_x - low_x, r.part_x - low_x + r.part_w)
        values[spot] = np.frombuffer(r.part_values, np.uint8).reshape(r.part_h, r.part_w, r.part_n)
        there[spot] = True
    own = slice(y - low_y, min(y + cell, int(first["roi_rows"])) - low_y), slice(x - low_x, min(x + cell, int(first["roi_cols"])) - low_x)
    return values, there, own, (low_y, low_x)


def _shifted(values: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The neighbour at (dy, dx) of every element; 0 beyond the borders."""
    h, w = values.shape
    wide = np.pad(values, 1)
    return wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]


def edge_classes(gray: np.ndarray, low: int = EDGE_LOW, high: int = EDGE_HIGH) -> tuple[np.ndarray, np.ndarray]:
    """Weak and strong edge pixels: 3 x 3 gradients with repeated borders, magnitude |dx| + |dy|, thinned across the edge's direction."""
    wide = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    at = lambda dy, dx: wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    ax, ay = np.abs(gx), np.abs(gy)
    size = ax + ay
    flat, steep = (ay << 15) < ax * TAN_22, (ay << 15) > ax * TAN_22 + (ax << 16)
    across = (size > _shifted(size, 0, -1)) & (size >= _shifted(size, 0, 1))
    along = (size > _shifted(size, -1, 0)) & (size >= _shifted(size, 1, 0))
    falling = (size > _shifted(size, -1, -1)) & (size > _shifted(size, 1, 1))
    rising = (size > _shifted(size, -1, 1)) & (size > _shifted(size, 1, -1))
    top = np.where(flat, across, np.where(steep, along, np.where((gx < 0) == (gy < 0), falling, rising)))
    return top & (size > low), top & (size > high)


def opened(mask: np.ndarray) -> np.ndarray:
    """The pixels in some 2 x 2 square of set pixels."""
    corner = mask & _shifted(mask, 0, 1) & _shifted(mask, 1, 0) & _shifted(mask, 1, 1)
    return corner | _shifted(corner, 0, -1) | _shifted(corner, -1, 0) | _shifted(corner, -1, -1)


def labelled(mask: np.ndarray) -> np.ndarray:
    """Per pixel the place of its 8-connected component's first pixel in reading order, -1 outside, by joining the runs of neighbouring rows."""
    h, w = mask.shape
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    wide = w + 2
    first = np.searchsorted(row * wide + end, (row - 1) * wide + start, "left")
    past = np.searchsorted(row * wide + start, (row - 1) * wide + end, "right")
    below = np.repeat(np.arange(len(row)), past - first)
    above = np.arange(len(below)) - np.repeat(np.cumsum(past - first) - (past - first), past - first) + np.repeat(first, past - first)
    root = np.arange(len(row))
    while len(below):
        low = np.minimum(root[below], root[above])
        new = root.copy()
        np.minimum.at(new, root[below], low)
        np.minimum.at(new, root[above], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    out = np.full((h, w), -1, np.int64)
    out[mask] = np.repeat((row * w + start)[root], end - start)
    return out


def _parts(mask: np.ndarray, marks: np.ndarray, y: int, x: int, rows: int, cols: int) -> list[tuple]:
    """One row per component of a cell whose corner is at (y, x): label, box, area, sum of rows, is a pixel marked, border pixels, pixels ahead."""
    h, w = mask.shape
    place = labelled(mask)
    py, px = np.nonzero(mask)
    names, who = np.unique(place[mask], return_inverse=True)
    n = len(names)
    box = np.full((4, n), -1, np.int64)
    box[:2] = max(h, w)
    np.minimum.at(box[0], who, px), np.minimum.at(box[1], who, py), np.maximum.at(box[2], who, px + 1), np.maximum.at(box[3], who, py + 1)
    area, marked = np.bincount(who, minlength=n), np.bincount(who, marks[mask], n) > 0
    sums = np.bincount(who, py + y, n)
    rim = (py == 0) | (py == h - 1) | (px == 0) | (px == w - 1)
    own, ahead = [[] for _ in names], [[] for _ in names]
    for i, a, b in zip(who[rim].tolist(), py[rim].tolist(), px[rim].tolist()):
        own[i].append((y + a) * cols + x + b)
        for da, db in ((0, 1), (1, -1), (1, 0), (1, 1)):
            inside = 0 <= a + da < h and 0 <= b + db < w
            if not inside and y + a + da < rows and 0 <= x + b + db < cols:
                ahead[i].append((y + a + da) * cols + x + b + db)
    label = (names // w + y) * cols + names % w + x
    left, top, right, bottom = box + np.array([x, y, x, y])[:, None]
    return list(zip(*(v.tolist() for v in (label, left, top, right, bottom, area, sums, marked)), own, ahead))


def joined_labels(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``root``, the smallest label of the parts that hang together across borders.

    Every round a label and the root it points to take the smallest root next to them, then roots are followed one step; rounds grow
    with the logarithm of the longest chain. Labels of one frame spread over all tasks; each round is written to the checkpoint folder.
    """
    k = list(keys)
    here = parts.select(*k, F.col("label").alias("a"), F.explode("own").alias("pos"))
    there = parts.select(*k, F.col("label").alias("b"), F.explode("ahead").alias("pos"))
    links = here.join(there, [*k, "pos"]).select(*k, "a", "b")
    both = _saved(links.union(links.select(*k, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if both.isEmpty():
        return parts.withColumn("root", F.col("label"))
    roots = _saved(both.groupBy(*k, "a").agg(F.min("b").alias("_low")).select(*k, "a", F.least("_low", "a").alias("root")))
    while True:
        near = both.join(roots.select(*k, F.col("a").alias("b"), F.col("root").alias("_next")), [*k, "b"]).groupBy(*k, "a").agg(F.min("_next").alias("_next"))
        offers = roots.join(near, [*k, "a"]).where("_next < root")
        moves = offers.select(*k, F.explode(F.array("a", "root")).alias("a"), "_next").groupBy(*k, "a").agg(F.min("_next").alias("_next"))
        hooked = roots.join(moves, [*k, "a"], "left").select(*k, "a", F.least("root", "_next").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        ahead = hooked.select(*k, F.col("a").alias("root"), F.col("root").alias("_far"))
        moved = (F.col("_moved") | (F.col("_far") < F.col("root"))).alias("_moved")
        followed = _saved(hooked.join(ahead, [*k, "root"]).select(*k, "a", F.col("_far").alias("root"), moved))
        roots = followed.drop("_moved")
        if followed.where("_moved").isEmpty():
            break
    return parts.join(roots.withColumnRenamed("a", "label"), [*k, "label"], "left").withColumn("root", F.coalesce("root", "label"))


def detect_tiled_components(tiles: DataFrame, keys: Sequence[str] = FRAME, cell: int = 256, **settings) -> DataFrame:
    """Connected components of likely caption pixels in the bottom region of each frame, as ``apply.detect_caption_components`` gives them.

    ``tiles``: ``keys, frame_width, frame_height, x, y, width, height, channels, pixels``. Coloured pixels count next to an edge (with
    hysteresis, ``edge_low`` and ``edge_high``), and only pixels in a 2 x 2 square of candidates remain. Pixels that no tile brings are
    black and never candidates. Tiles with a null or without pixels take no part, equal tiles count once; other columns are not read.
    """
    chosen = {**CAPTION_SETTINGS, "edge_low": EDGE_LOW, "edge_high": EDGE_HIGH, **settings}
    k = list(keys)
    names = ("frame_width", "frame_height", "x", "y", "width", "height", "channels", "pixels")
    given = tiles.select(*k, *names).dropna().where("width > 0 AND height > 0 AND channels > 0").dropDuplicates([*k, "x", "y", "width", "height"])
    share = min(0.95, max(0.05, chosen["bottom_region_fraction"]))
    top = F.greatest(F.lit(0), F.least(F.col("frame_height") - 1, F.bround(F.col("frame_height") * (1.0 - share)))).cast("long")
    cut = F.greatest(F.lit(0), top - F.col("y")).cast("long")
    whole = given.withColumns({"_top": top, "_cut": cut}).where("_cut < height")
    line = F.col("width") * F.col("channels")
    blocks = whole.select(
        *k,
        (F.col("y") + F.col("_cut") - F.col("_top")).cast("long").alias("part_y"),
        F.col("x").cast("long").alias("part_x"),
        (F.col("height") - F.col("_cut")).cast("int").alias("part_h"),
        F.col("width").cast("int").alias("part_w"),
        (F.col("frame_height") - F.col("_top")).cast("long").alias("roi_rows"),
        F.col("frame_width").cast("long").alias("roi_cols"),
        F.col("channels").cast("int").alias("part_n"),
        F.substring("pixels", (F.col("_cut") * line + 1).cast("int"), line * (F.col("height") - F.col("_cut"))).alias("part_values"),
    )
    base = _schema(blocks, k)
    place = [*k, "cell_row", "cell_col"]

    def written(pdf, values, own, corner):
        first, inner = pdf.iloc[0], np.ascontiguousarray(values[own])
        spot = (first["cell_row"], first["cell_col"], corner[0] + own[0].start, corner[1] + own[1].start, *inner.shape, first["roi_rows"], first["roi_cols"], 1, inner.tobytes())
        return pd.DataFrame([(*(first[c] for c in k), *spot)], columns=[*place, "part_y", "part_x", "part_h", "part_w", "roi_rows", "roi_cols", "part_n", "part_values"])

    def classify(pdf: pd.DataFrame) -> pd.DataFrame:
        values, there, own, corner = _assembled(pdf, cell)
        gray = np.rint(_gray(values)).astype(np.int64)
        weak, strong = edge_classes(gray, chosen["edge_low"], chosen["edge_high"])
        color = _colored(values, chosen) if values.shape[2] > 1 else np.zeros(there.shape, bool)
        bits = (gray >= chosen["light_threshold"]) * LIGHT + color * COLORED + weak * WEAK + strong * STRONG
        return written(pdf, (bits * there).astype(np.uint8), own, corner)

    def components(pdf: pd.DataFrame, wanted, marks) -> pd.DataFrame:
        """Rows of one cell's components: of the pixels with all wanted conditions, given the cell's bits."""
        values, _, own, corner = _assembled(pdf, cell)
        first, bits = pdf.iloc[0], values[:, :, 0]
        rows = _parts(wanted(bits)[own], (bits[own] & marks) > 0, corner[0] + own[0].start, corner[1] + own[1].start, int(first["roi_rows"]), int(first["roi_cols"]))
        head = tuple(first[c] for c in place)
        return pd.DataFrame([(*head, *r) for r in rows], columns=[*place, "label", "x", "y", "right", "bottom", "area", "sum_y", "marked", "own", "ahead"])

    def masked(bits: np.ndarray) -> np.ndarray:
        edge = (bits & EDGE) > 0
        near = np.any([_shifted(edge, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        return opened(((bits & LIGHT) > 0) | (((bits & COLORED) > 0) & near))

    cells = _saved(spread_cells(blocks, k, cell).groupBy(*place).applyInPandas(classify, base + _CELL))
    lines = _saved(cells.groupBy(*place).applyInPandas(lambda pdf: components(pdf, lambda b: (b & WEAK) > 0, STRONG), base + _PART))
    found = joined_labels(lines, k)
    kept = found.join(found.where("marked").select(*k, "root").distinct(), [*k, "root"], "left_semi")
    edges = kept.groupBy(*place).agg(F.sort_array(F.collect_list("label")).alias("part_labels"))  # of one cell

    def with_edges(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                bits = np.frombuffer(r.part_values, np.uint8).reshape(r.part_h, r.part_w).copy()
                at = labelled((bits & WEAK) > 0)
                if r.part_labels is not None:
                    label = (at // r.part_w + r.part_y) * r.roi_cols + at % r.part_w + r.part_x
                    bits[(at >= 0) & np.isin(label, r.part_labels)] |= EDGE
                out.append(bits.tobytes())
            yield pdf.drop(columns="part_labels").assign(part_values=out)

    full = cells.join(edges, place, "left").mapInPandas(with_edges, base + _CELL).drop("cell_row", "cell_col")
    parts = spread_cells(full, k, cell).groupBy(*place).applyInPandas(lambda pdf: components(pdf, masked, 0), base + _PART)
    found = joined_labels(_saved(parts), k).groupBy(*k, "root")
    boxes = found.agg(*[F.min(c).alias(c) for c in ("x", "y")], *[F.max(c).alias(c) for c in ("right", "bottom")], *[F.sum(c).alias(c) for c in ("area", "sum_y")])
    boxes = _saved(boxes)
    numbered = blocked_row_number(boxes.select(*k, "root"), k, ["root"], index_block("root"), "_rn")
    size = blocks.groupBy(*k).agg(F.max("roi_cols").alias("roi_width"), F.max("roi_rows").alias("roi_height"))
    whole = boxes.join(numbered, [*k, "root"]).join(size, k)
    ints = {"component_id": F.col("_rn"), "x": F.col("x"), "y": F.col("y"), "width": F.col("right") - F.col("x"), "height": F.col("bottom") - F.col("y"), "area": F.col("area")}
    return whole.select(
        *k, *[c.cast("int").alias(n) for n, c in ints.items()], (F.col("sum_y") / F.col("area")).alias("center_y"), F.col("roi_width").cast("int"), F.col("roi_height").cast("int")
    )
