"""The planners as SQL table functions.

    SELECT * FROM plan_segments(TABLE(clips), frames => 'frame_count', fps => 'frame_rate', seconds => 10)
    SELECT * FROM plan_temporal_chunks(TABLE(clips) PARTITION BY source_id, chunk => 32)
    SELECT * FROM plan_tiles(TABLE(frames), tile => 256, overlap => 32, mode => 'average')

Each is polymorphic: ``analyze`` looks at the table given and at the options, checks them before anything runs, and gives the planner's columns
beside the table's own (those that are not its sizes), with their types. A source is planned from its row alone, so without ``PARTITION BY``
nothing is shuffled; with it the planners run where the partitions are. Rows are those of ``plan_segments`` and its fellows over DataFrames.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, NumericType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from framelane.plans import segments, tiles


def _constant(argument, default):
    """The value of an option, which must be a constant; its default where it is left out."""
    if argument is None:
        return default
    if not argument.isConstantExpression:
        raise ValueError("options must be constants")
    return argument.value


def _planned(table: AnalyzeArgument, sizes: dict[str, str], columns: dict[str, type], keep_sizes: bool) -> AnalyzeResult:
    """The table's columns and the planner's; ``sizes``: option and column that must be there and numeric."""
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    fields = {f.name: f for f in table.dataType.fields}
    for option, name in sizes.items():
        if name not in fields:
            raise ValueError(f"{option} => '{name}' is not a column of the table; it has {', '.join(fields)}")
        if not isinstance(fields[name].dataType, NumericType):
            raise ValueError(f"{option} => '{name}' is not a number")
    own = [f for n, f in fields.items() if keep_sizes or n not in sizes.values()]
    if clash := sorted({f.name for f in own} & set(columns)):
        raise ValueError(f"columns of the table have names of the plan: {', '.join(clash)}")
    return AnalyzeResult(StructType([*own, *[StructField(n, kind()) for n, kind in columns.items()]]))


def _whole(value) -> int:
    return 0 if value is None else int(value)


def _own(row, left_out: set[str]) -> tuple:
    return tuple(v for n, v in row.asDict(recursive=False).items() if n not in left_out)


SEGMENT_COLUMNS = {
    "total_frames": LongType, "segment_frames": LongType, "segment_count": LongType, "segment_index": LongType,
    "start_frame": LongType, "frame_count": LongType, "start_seconds": DoubleType, "duration_seconds": DoubleType,
}


class PlanSegments:
    """``plan_segments(table, frames => 'frame_count', fps => 'frame_rate', seconds => 10, single => false)``"""

    @staticmethod
    def analyze(sources: AnalyzeArgument, frames=None, fps=None, seconds=None, single=None) -> AnalyzeResult:
        _constant(seconds, None), _constant(single, None)
        return _planned(sources, {"frames": _constant(frames, "frame_count"), "fps": _constant(fps, "frame_rate")}, SEGMENT_COLUMNS, False)

    def eval(self, sources, frames="frame_count", fps="frame_rate", seconds=segments.SEGMENT_SECONDS, single=False):
        total, rate = _whole(sources[frames]), sources[fps]
        if total <= 0:
            return
        rate = float(rate) if rate is not None and rate > 0 else 1.0
        wanted = float(seconds) if seconds is not None and seconds > 0 else segments.SEGMENT_SECONDS
        length = total if single else max(1, min(max(segments.SEGMENT_MIN_FRAMES, round(rate * wanted)), total))
        own, count = _own(sources, {frames, fps}), -(-total // length)
        for index in range(count):
            start = index * length
            size = min(length, total - start)
            yield (*own, total, length, count, index, start, size, start / rate, size / rate)


CHUNK_COLUMNS = dict.fromkeys(("chunk_start", "chunk_end", "chunk_index", "expanded_start", "expanded_end", "trim_start", "trim_end", "pad_frames"), LongType)


class PlanTemporalChunks:
    """``plan_temporal_chunks(table, frames => 'frame_count', chunk => 32, radius => 2, minimum => 5)``"""

    @staticmethod
    def analyze(sources: AnalyzeArgument, frames=None, chunk=None, radius=None, minimum=None) -> AnalyzeResult:
        if min(_constant(radius, 0), _constant(minimum, 0)) < 0:
            raise ValueError("radius and minimum must not be negative")
        _constant(chunk, None)
        return _planned(sources, {"frames": _constant(frames, "frame_count")}, CHUNK_COLUMNS, False)

    def eval(self, sources, frames="frame_count", chunk=32, radius=segments.TEMPORAL_RADIUS, minimum=segments.TEMPORAL_MIN_FRAMES):
        total, step, own = _whole(sources[frames]), max(1, chunk), _own(sources, {frames})
        for index, start in enumerate(range(0, total, step)):
            end = min(total, start + step)
            low, high = max(0, start - radius), min(total, end + radius)
            yield (*own, start, end, index, low, high, start - low, end - low, max(0, minimum - (high - low)))


TILE_COLUMNS = dict.fromkeys(("tile_row", "tile_col"), IntegerType) | dict.fromkeys(("top", "left", "bottom", "right", "crop_top", "crop_left", "crop_bottom", "crop_right"), LongType)


class PlanTiles:
    """``plan_tiles(table, tile => 256, overlap => 0, mode => 'crop', multiple => 1, width => 'width', height => 'height')``"""

    @staticmethod
    def analyze(frames: AnalyzeArgument, tile=None, overlap=None, mode=None, multiple=None, width=None, height=None) -> AnalyzeResult:
        if tile is None:
            raise ValueError("tile => size is needed")
        if _constant(mode, "crop") not in ("crop", "average"):
            raise ValueError(f"unknown tile mode {mode.value!r}")
        _constant(tile, None), _constant(overlap, None), _constant(multiple, None)
        return _planned(frames, {"width": _constant(width, "width"), "height": _constant(height, "height")}, TILE_COLUMNS, True)

    def eval(self, frames, tile, overlap=0, mode="crop", multiple=1, width="width", height="height"):
        if frames[width] is None or frames[height] is None:
            return
        own, sizes = _own(frames, set()), [int(frames[height]), int(frames[width])]
        across, down = [self._spans(s, sizes, tile, overlap, mode, multiple) for s in (1, 0)]
        for row, y in enumerate(down):
            for col, x in enumerate(across):
                yield (*own, row, col, y[0], x[0], y[1], x[1], y[2], x[2], y[3], x[3])

    @staticmethod
    def _spans(side: int, sizes: list[int], tile: int, overlap: int, mode: str, multiple: int) -> list[tuple[int, int, int, int]]:
        """Along one side: what each tile reads, and what it gives."""
        size = sizes[side]
        if mode == "crop":
            if tile <= 0 or max(sizes) <= tile:
                return [(0, size, 0, size)]
            halo = tiles.tile_halo(tile)
            return [(max(0, at - halo), min(size, at + tile + halo), at, min(size, at + tile)) for at in range(0, size, tile)]
        m = max(1, multiple)
        padded = [-(-s // m) * m for s in sizes]
        if tile <= 0 or max(padded) <= tile:
            return [(0, padded[side], 0, size)]
        small = min(tile, *padded)
        edge = max(m, small - small % m)
        step = max(m, edge - min(max(0, overlap), max(0, edge - m)))
        starts = sorted({*range(0, max(1, padded[side] - edge), step), max(0, padded[side] - edge)})
        return [(at, at + edge, min(size, at), min(size, at + edge)) for at in starts]


FUNCTIONS = {"plan_segments": PlanSegments, "plan_temporal_chunks": PlanTemporalChunks, "plan_tiles": PlanTiles}


def register(spark: SparkSession) -> None:
    """Make the planners known to SQL in this session."""
    for name, handler in FUNCTIONS.items():
        # rows are planned one by one, and Arrow would make a table for each: ten times as slow
        spark.udtf.register(name, udtf(handler, useArrow=False))


__all__ = ["FUNCTIONS", "PlanSegments", "PlanTemporalChunks", "PlanTiles", "register"]
