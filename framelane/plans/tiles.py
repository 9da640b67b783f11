"""Spatial tiling plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TILE_HALO_MAX = 32
TILE_HALO_MIN = 8


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def tile_halo(tile: int) -> int:
    """Context read around a crop-mode tile."""
    return min(TILE_HALO_MAX, max(TILE_HALO_MIN, tile // 4))


def tile_plan(
    width: Column, height: Column, tile: int, overlap: int = 0, mode: str = "crop", multiple: int = 1
) -> Column:
    """The tiles of a frame as an array of structs, in row order.

    ``tile_row, tile_col``; ``top, left, bottom, right`` is what the model reads and ``crop_*`` the part of the frame
    the tile contributes. ``crop``: disjoint cores with a halo that is cut away afterwards. ``average``: overlapping
    tiles, the last one flush with the edge, summed and divided by the coverage; the frame is first padded to
    ``multiple``.
    """
    w, h = width.cast("bigint"), height.cast("bigint")
    if mode not in ("crop", "average"):
        raise ValueError(f"unknown tile mode {mode!r}")
    whole_spot = F.array(_long(0))
    if mode == "crop":
        whole = F.lit(tile <= 0) | ((w <= tile) & (h <= tile))
        halo = tile_halo(tile)

        def starts(size: Column) -> Column:
            return F.when(whole, whole_spot).otherwise(F.sequence(_long(0), size - 1, _long(max(1, tile))))

        def span(start: Column, size: Column) -> tuple[Column, ...]:
            end = F.when(whole, size).otherwise(F.least(size, start + tile))
            return F.greatest(_long(0), start - halo), F.least(size, end + halo), start, end

        rows, cols = starts(h), starts(w)
    else:
        m = max(1, multiple)

        def padded(size: Column) -> Column:
            return size + F.pmod(_long(m) - F.pmod(size, _long(m)), _long(m))

        pw, ph = padded(w), padded(h)
        whole = F.lit(tile <= 0) | ((ph <= tile) & (pw <= tile))
        small = F.least(_long(tile), ph, pw)
        side = F.greatest(_long(m), small - F.pmod(small, _long(m)))
        step = F.greatest(_long(m), side - F.least(_long(max(0, overlap)), F.greatest(_long(0), side - m)))

        def starts(size: Column) -> Column:
            regular = F.sequence(_long(0), F.greatest(_long(1), size - side) - 1, step)
            flush = F.array(F.greatest(_long(0), size - side))
            return F.when(whole, whole_spot).otherwise(F.array_sort(F.array_distinct(F.concat(regular, flush))))

        def span(start: Column, size: Column) -> tuple[Column, ...]:
            end = F.when(whole, padded(size)).otherwise(start + side)
            return start, end, F.least(size, start), F.least(size, end)

        rows, cols = starts(ph), starts(pw)

    def spot(top: Column, row: Column, left: Column, col: Column) -> Column:
        y, x = span(top, h), span(left, w)
        values = {
            "tile_row": row, "tile_col": col,
            "top": y[0], "left": x[0], "bottom": y[1], "right": x[1],
            "crop_top": y[2], "crop_left": x[2], "crop_bottom": y[3], "crop_right": x[3],
        }
        return F.struct(*[v.alias(n) for n, v in values.items()])

    return F.flatten(F.transform(rows, lambda top, row: F.transform(cols, lambda left, col: spot(top, row, left, col))))


def plan_tiles(
    df: DataFrame,
    tile: int,
    overlap: int = 0,
    mode: str = "crop",
    multiple: int = 1,
    width: str = "width",
    height: str = "height",
) -> DataFrame:
    """One row per tile of :func:`tile_plan`."""
    plan = tile_plan(F.col(width), F.col(height), tile, overlap, mode, multiple)
    return df.select("*", F.explode(plan).alias("_tile")).select(*df.columns, "_tile.*")
