"""Frame metrics from the parts of frames.

A frame too large for a task is stored as tiles. Each tile gives moments per channel (number of values, sums, squares, cross products, largest
difference), which add up: ``merge_metrics`` sums them per frame, tasks first, and takes the metrics from the sums. So the metrics of a frame do
not depend on how it was cut, and no task sees more than a tile. Tiles hold whole pixels and do not overlap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framelane.operators.quality import _channel_ssim, _in_channel, _moments

#: Of one channel of a tile: values, absolute and squared differences, the largest one, sums, squares and cross products of both sides.
MOMENTS = ("n", "ad", "sd", "mx", "sa", "sb", "saa", "sbb", "sab")
FRAME = ("source_id", "frame_index")


def tile_moments(tiles: DataFrame, keys: Sequence[str] = FRAME, channels: int = 1, reference: str = "reference", candidate: str = "candidate") -> DataFrame:
    """``keys, channel`` and moments of every tile whose pixels are ``ARRAY<DOUBLE>``; stays in the JVM."""
    zipped = F.zip_with(F.col(reference).cast("array<double>"), F.col(candidate).cast("array<double>"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = [_moments(F.filter(zipped, _in_channel(k, channels)) if channels > 1 else zipped) for k in range(channels)]
    return tiles.select(*keys, F.posexplode(F.array(*each)).alias("channel", "m")).select(*keys, "channel", "m.*")


def binary_tile_moments(tiles: DataFrame, keys: Sequence[str] = FRAME, channels: str = "channels", reference: str = "reference", candidate: str = "candidate") -> DataFrame:
    """The same for raw 8-bit pixels with interleaved channels; sums are whole numbers, so they are exact at any size."""
    given = tiles.select(*keys, F.col(reference).alias("_a"), F.col(candidate).alias("_b"), F.col(channels).cast("int").alias("_n"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.select(*keys).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, rows = [], []
            for i, (a, b, n) in enumerate(zip(*(batch.column(c) for c in ("_a", "_b", "_n")))):
                x, y = (np.frombuffer(v.as_buffer() or b"", np.uint8).reshape(-1, n.as_py()).astype(np.int64) for v in (a, b))
                d = np.abs(x - y)
                sums = [d, d * d, None, x, y, x * x, y * y, x * y]
                for k in range(x.shape[1]):
                    place.append(i)
                    rows.append([k, len(x), *(int(d[:, k].max(initial=0)) if s is None else int(s[:, k].sum()) for s in sums)])
            own = batch.select(list(keys)).take(pa.array(place, pa.int64()))
            made = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([float(r[j]) for r in rows], pa.float64()) for j in range(1, 10))]
            yield pa.RecordBatch.from_arrays([*own.columns, *made], [*keys, "channel", *MOMENTS])

    return given.mapInArrow(run, ", ".join([*fields, "channel int", *[f"{m} double" for m in MOMENTS]]))


def add_moments(moments: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Moments of several parts together, one row per key and channel; parts of parts may be added again."""
    total = {m: F.max(m) if m == "mx" else F.sum(m) for m in MOMENTS}
    return moments.groupBy(*keys, "channel").agg(*[c.alias(m) for m, c in total.items()])


def merge_metrics(moments: DataFrame, keys: Sequence[str] = FRAME, peak: float = 255.0, digits: int = 6) -> DataFrame:
    """MAE, RMSE, largest error, PSNR (infinite for equal frames) and SSIM of each key, from the moments of its parts.

    The metrics are those of ``quality.frame_metrics`` over the whole frame. Keys without parts, or with empty parts only, give no row.
    """
    level = F.lit(float(peak))
    channel = F.struct(*[F.col(m) for m in MOMENTS])
    n = F.sum("n")
    parts = add_moments(moments, keys).where("n > 0").withColumn("_ssim", _channel_ssim(channel, level))
    summed = parts.groupBy(*keys).agg(
        n.alias("_n"), (F.sum("ad") / n).alias("_mae"), (F.sum("sd") / n).alias("_mse"), F.max("mx").alias("max_absolute_error"), F.avg("_ssim").alias("_ssim")
    )
    psnr: Column = F.when(F.col("_mse") <= 0, F.lit(float("inf"))).otherwise(F.round(20 * F.log10(level) - 10 * F.log10("_mse"), digits))
    return summed.select(
        *keys,
        F.round("_mae", digits).alias("mean_absolute_error"),
        F.round(F.sqrt("_mse"), digits).alias("root_mean_squared_error"),
        "max_absolute_error",
        psnr.alias("psnr"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_ssim"))), digits).alias("ssim"),
    )
