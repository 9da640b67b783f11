"""Caption geometry: which connected components are text, how they group into line boxes, and their companions.

A component is compared with the others of its row (a band around its centre whose height depends on its own). The
rules need only a few facts about each distinct vertical centre of a frame, so components are first reduced to lines
and bands are joined to lines on ``(frame, vertical bucket)``. No step pairs up the components of a frame. Components are
dealt out by frame once; what follows groups, sorts and joins inside frames and moves no row again.

Components of a frame that share a number are one anchor: its band is all of theirs together, and what lies in several of them
counts as often.

Components: ``keys, component_id, x, y, width, height, area, center_y, roi_width, roi_height``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from framelane.functions.numeric import round_half_even
from framelane.operators import caption_bands

FRAME_KEYS = ("clip_id", "frame_index")
BUCKET = 32


def _whole(value: Column) -> Column:
    """Truncation of a non-negative number."""
    return F.floor(value).cast("bigint")


def _at_least(low: int, value: Column) -> Column:
    return F.greatest(F.lit(low).cast("bigint"), value)


def _wide() -> Column:
    return F.col("width") >= _at_least(42, _whole(F.col("roi_width") * 0.16))


def _fill() -> Column:
    return F.col("area") / F.greatest(F.lit(1), F.col("width") * F.col("height"))


def _tolerance() -> Column:
    return F.greatest(F.lit(10.0), F.col("height").cast("double") * 1.8)


def size_gate(components: DataFrame) -> DataFrame:
    """Drop components whose area, height, width or fill cannot be text."""
    region = F.col("roi_height") * F.col("roi_width")
    min_area = _at_least(3, round_half_even(region * 0.000015))
    max_area = F.greatest(min_area + 1, round_half_even(region * 0.045))
    min_height = _at_least(4, round_half_even(F.col("roi_height") * 0.018))
    max_height = _at_least(8, round_half_even(F.col("roi_height") * 0.35))
    solid = (_fill() > 0.9) & (F.col("width") > F.col("roi_width") * 0.12)
    return components.where(
        F.col("area").between(min_area, max_area)
        & (F.col("width") >= 2)
        & F.col("height").between(min_height, max_height)
        & ~solid
    )


def filter_text_components(components: DataFrame, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Components that pass the size gate and either are caption-wide or lie in a row of at least three.

    Components are moved and sorted once; then whole frames pass in batches (``caption_bands``). A task holds one frame's components.
    """
    alone = (
        _wide()
        & F.col("height").between(6, _at_least(18, _whole(F.col("roi_height") * 0.16)))
        & (_fill() <= 0.72)
    )
    dealt = size_gate(components).repartition(*keys).withColumns({"_tol": _tolerance(), "_alone": F.coalesce(alone, F.lit(False))})

    def run(batches):
        for table in caption_bands.whole_frames(batches, keys):
            kept = caption_bands.text_rows(table, keys) | table.column("_alone").to_numpy()
            yield from table.drop_columns(["_tol", "_alone"]).filter(pa.array(kept)).to_batches()

    return dealt.sortWithinPartitions(*keys, "center_y", "_tol", "component_id").mapInArrow(run, components.schema)


def cluster_caption_lines(
    components: DataFrame, padding: int, max_gap: int = 0, keys: Sequence[str] = FRAME_KEYS
) -> DataFrame:
    """Padded line boxes ``x1, y1, x2, y2`` per frame, deduplicated, with ``first_component`` and ``row_left`` giving
    the order in which they first appear.

    Each line is first merged into clusters on its own (they can only grow when lines meet), so a band holds at most
    ``roi_width / gap`` clusters per line. Components are moved and sorted once; then whole frames pass in batches (``caption_bands``).
    """
    usable = components.where((F.col("width") > 0) & (F.col("height") > 0) & (F.col("area") > 0))
    if padding <= 0:
        usable = usable.where(F.lit(False))
    gap = (
        F.lit(max(1, max_gap)).cast("bigint")
        if max_gap > 0
        else _at_least(48, round_half_even(F.col("roi_width") * 0.08))
    )
    columns = (*keys, "component_id", "x", "y", "width", "height", "center_y", "roi_width", "roi_height")
    facts = {"_tol": _tolerance(), "_gap": gap, "_wide": F.coalesce(_wide(), F.lit(False))}
    dealt = usable.select(*columns).repartition(*keys).withColumns(facts)
    sides = dealt.select(
        *keys,
        F.greatest(F.lit(0), F.col("x") - padding * 2).alias("x1"),
        F.greatest(F.lit(0), F.col("y") - padding).alias("y1"),
        F.least(F.col("roi_width"), F.col("x") + F.col("width") + padding * 2).alias("x2"),
        F.least(F.col("roi_height"), F.col("y") + F.col("height") + padding).alias("y2"),
        F.col("component_id").alias("first_component"),
        F.col("x").alias("row_left"),
    )
    schema = to_arrow_schema(sides.schema)

    def run(batches):
        for table in caption_bands.whole_frames(batches, keys):
            boxes = caption_bands.line_boxes(table, keys, padding)
            if boxes is not None:
                yield from boxes.cast(schema).to_batches()

    return dealt.sortWithinPartitions(*keys, "center_y", "x").mapInArrow(run, sides.schema)


def absorb_companions(
    components: DataFrame, boxes: DataFrame, padding: int, keys: Sequence[str] = FRAME_KEYS
) -> DataFrame:
    """Components next to an accepted box, with the first box that takes them and the padded rectangle they add.

    Components of one frame with the same rounded centre and the same span meet the boxes once. Of components that share a number
    the one with the first box counts, and of several at that box the one with the smallest rectangle in order of its sides.
    """
    reach = max(padding * 4, 64)
    center = round_half_even("center_y")
    staged = components.repartition(*keys).withColumns({"_cy": center, "_right": F.col("x") + F.col("width")})
    spots = staged.select(*keys, "_cy", "x", "_right").distinct().withColumn("_bucket", F.floor(F.col("_cy") / BUCKET))
    zones = boxes.withColumn(
        "_bucket",
        F.explode(
            F.sequence(F.floor((F.col("y1") - padding) / BUCKET), F.floor((F.col("y2") + padding) / BUCKET))
        ),
    )
    distance = F.greatest(F.col("x1") - F.col("_right"), F.col("x") - F.col("x2"), F.lit(0))
    matched = (
        spots.join(zones, [*keys, "_bucket"])
        .where(F.col("_cy").between(F.col("y1") - padding, F.col("y2") + padding) & (distance <= reach))
        .groupBy(*keys, "_cy", "x", "_right")
        .agg(F.min(F.struct("first_component", "row_left", "x1", "y1", "x2", "y2")).alias("box"))
    )
    side = F.struct(
        F.greatest(F.lit(0), F.col("x") - padding * 2).alias("left"),
        F.greatest(F.lit(0), F.col("y") - padding).alias("top"),
        F.least(F.col("roi_width"), F.col("_right") + padding * 2).alias("right"),
        F.least(F.col("roi_height"), F.col("y") + F.col("height") + padding).alias("bottom"),
    )
    taken = staged.join(matched, [*keys, "_cy", "x", "_right"]).select(*keys, "component_id", F.struct("box", side.alias("side")).alias("_t"))
    return (
        taken.groupBy(*keys, "component_id")
        .agg(F.min("_t").alias("_t"))
        .select(
            *keys,
            "component_id",
            *[F.col(f"_t.box.{c}").alias(f"box_{c}") for c in ("x1", "y1", "x2", "y2")],
            *[F.col(f"_t.side.{c}").alias(c) for c in ("left", "top", "right", "bottom")],
        )
    )
