"""Frame-pair quality metrics, masked error, flicker, mask smoothing and seam detection.

Frames arrive in one of two shapes: small or derived signals as ``ARRAY<DOUBLE>`` (metrics stay JVM-side), or raw
``BINARY`` pixels (metrics run as numpy inside ``mapInPandas``, one row out per frame pair).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from framelane.operators.ordered import blocked_lag, index_block, salted_join

METRIC_COLUMNS = ("mean_absolute_error", "root_mean_squared_error", "max_absolute_error", "psnr", "ssim")
SSIM_C1, SSIM_C2 = 0.01**2, 0.03**2


#: Masks that a task sorts together.
MASK_BLOCK = 256


def pair_frames(
    reference: DataFrame,
    candidate: DataFrame,
    keys: Sequence[str] = ("source_id", "frame_index"),
    value: str = "pixels",
    shape: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Strict 1:1 pairing. Returns (pairs with ``reference`` and ``candidate``, rejects with ``reason``)."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(value, *shape).alias(name))

    joined = side(reference, "_r").join(side(candidate, "_c"), list(keys), "full_outer")
    size = F.size if dict(reference.dtypes)[value].startswith("array") else F.octet_length
    same = size(F.col(f"_r.{value}")) == size(F.col(f"_c.{value}"))
    for c in shape:
        same = same & F.col(f"_r.{c}").eqNullSafe(F.col(f"_c.{c}"))
    reason = (
        F.when(F.col("_r").isNull(), F.lit("missing reference"))
        .when(F.col("_c").isNull(), F.lit("missing candidate"))
        .when(~F.coalesce(same, F.lit(False)), F.lit("shape mismatch"))
    )
    joined = joined.withColumn("reason", reason)
    pairs = joined.where(F.col("reason").isNull()).select(
        *keys,
        F.col(f"_r.{value}").alias("reference"),
        F.col(f"_c.{value}").alias("candidate"),
        *[F.col(f"_r.{c}").alias(c) for c in shape],
    )
    return pairs, joined.where(F.col("reason").isNotNull()).select(*keys, "reason")


def _moments(zipped: Column) -> Column:
    """Sums over one channel of zipped ``(a, b)`` values, in a single pass."""
    zero = F.lit(0.0)
    names = ("n", "ad", "sd", "mx", "sa", "sb", "saa", "sbb", "sab")

    def step(acc: Column, p: Column) -> Column:
        a, b = p["a"], p["b"]
        d = F.abs(a - b)
        values = (
            acc["n"] + 1.0, acc["ad"] + d, acc["sd"] + d * d, F.greatest(acc["mx"], d), acc["sa"] + a, acc["sb"] + b,
            acc["saa"] + a * a, acc["sbb"] + b * b, acc["sab"] + a * b,
        )
        return F.struct(*[v.alias(n) for n, v in zip(names, values)])

    return F.aggregate(zipped, F.struct(*[zero.alias(n) for n in names]), step)


def _in_channel(k: int, channels: int):
    return lambda _, i: F.pmod(i, F.lit(channels)) == k


def _channel_ssim(m: Column, peak: Column) -> Column:
    """Global SSIM of one channel on the 0..1 scale, population variance."""
    n = m["n"]
    ma, mb = m["sa"] / n / peak, m["sb"] / n / peak
    scale = n * peak * peak
    va, vb, cov = m["saa"] / scale - ma * ma, m["sbb"] / scale - mb * mb, m["sab"] / scale - ma * mb
    return ((2 * ma * mb + SSIM_C1) * (2 * cov + SSIM_C2)) / ((ma * ma + mb * mb + SSIM_C1) * (va + vb + SSIM_C2))


def frame_metrics(
    pairs: DataFrame,
    reference: str = "reference",
    candidate: str = "candidate",
    peak: float = 255.0,
    channels: int = 1,
    digits: int = 6,
) -> DataFrame:
    """Add MAE, RMSE, max error, PSNR (infinite for equal frames) and SSIM per pair of ``ARRAY<DOUBLE>`` frames.

    Multi-channel frames are interleaved, as images are.
    """
    zipped = F.zip_with(
        F.col(reference).cast("array<double>"),
        F.col(candidate).cast("array<double>"),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    if channels == 1:
        moments = F.array(_moments(zipped))
    else:
        moments = F.array(*[_moments(F.filter(zipped, _in_channel(k, channels))) for k in range(channels)])

    def total(field: str) -> Column:
        return F.aggregate("_m", F.lit(0.0), lambda acc, m: acc + m[field])

    n = total("n")
    mse = total("sd") / n
    level = F.lit(float(peak))
    ssim = F.aggregate("_m", F.lit(0.0), lambda acc, m: acc + _channel_ssim(m, level)) / channels
    psnr = F.when(mse <= 0, F.lit(float("inf"))).otherwise(
        F.round(20 * F.log10(level) - 10 * F.log10(mse), digits)
    )
    return (
        pairs.withColumn("_m", moments)
        .withColumns(
            {
                "mean_absolute_error": F.round(total("ad") / n, digits),
                "root_mean_squared_error": F.round(F.sqrt(mse), digits),
                "max_absolute_error": F.aggregate("_m", F.lit(0.0), lambda acc, m: F.greatest(acc, m["mx"])),
                "psnr": psnr,
                "ssim": F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ssim)), digits),
            }
        )
        .drop("_m")
    )


def binary_frame_metrics(
    pairs: DataFrame,
    keys: Sequence[str] = ("source_id", "frame_index"),
    channels: str = "channels",
    digits: int = 6,
) -> DataFrame:
    """The same metrics for raw 8-bit pixels (``reference``, ``candidate`` BINARY, interleaved channels)."""
    fields = pairs.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += ", " + ", ".join(f"{c} double" for c in METRIC_COLUMNS)

    def compute(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for ref, cand, bands in zip(pdf["_r"], pdf["_c"], pdf["_ch"]):
                a = np.frombuffer(ref, dtype=np.uint8).astype(np.float64).reshape(-1, int(bands))
                b = np.frombuffer(cand, dtype=np.uint8).astype(np.float64).reshape(-1, int(bands))
                d = np.abs(a - b)
                mse = float(np.mean(d * d))
                x, y = a / 255.0, b / 255.0
                mx, my = x.mean(axis=0), y.mean(axis=0)
                vx, vy = x.var(axis=0), y.var(axis=0)
                cov = ((x - mx) * (y - my)).mean(axis=0)
                ssim = ((2 * mx * my + SSIM_C1) * (2 * cov + SSIM_C2)) / (
                    (mx**2 + my**2 + SSIM_C1) * (vx + vy + SSIM_C2)
                )
                psnr = float("inf") if mse <= 0 else 20 * np.log10(255.0) - 10 * np.log10(mse)
                rows.append(
                    (
                        round(float(d.mean()), digits),
                        round(float(np.sqrt(mse)), digits),
                        float(d.max()),
                        round(float(psnr), digits),
                        round(float(np.clip(ssim.mean(), 0.0, 1.0)), digits),
                    )
                )
            yield pd.concat(
                [pdf[list(keys)].reset_index(drop=True), pd.DataFrame(rows, columns=list(METRIC_COLUMNS))], axis=1
            )

    slim = pairs.select(
        *keys, F.col("reference").alias("_r"), F.col("candidate").alias("_c"), F.col(channels).alias("_ch")
    )
    return slim.mapInPandas(compute, schema)


def _metric_summary(grouped, *extra: Column, digits: int = 6) -> DataFrame:
    infinite = F.lit(float("inf"))
    finite = F.avg(F.when((F.col("psnr") < infinite) & (F.col("psnr") > -infinite), F.col("psnr")))
    return grouped.agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.round(F.avg("mean_absolute_error"), digits).alias("average_mean_absolute_error"),
        F.round(F.avg("root_mean_squared_error"), digits).alias("average_root_mean_squared_error"),
        F.coalesce(F.round(finite, digits), infinite).alias("average_psnr"),
        F.round(F.avg("ssim"), digits).alias("average_ssim"),
        F.max("max_absolute_error").alias("max_absolute_error"),
        *extra,
    )


def summarize_frame_metrics(df: DataFrame, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Count, mean MAE/RMSE/SSIM, mean of the finite PSNR (infinite if none is finite) and largest error.

    Groups without frames give no row.
    """
    out = _metric_summary(df.groupBy(*keys), digits=digits)
    return out if keys else out.where(F.col("frame_count") > 0)


def _with_master(pairs: DataFrame, master: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return pairs.join(master.select(*keys, F.col(value).alias("master")), list(keys), "left")


def triple_with_master(
    pairs: DataFrame, master: DataFrame, keys: Sequence[str] = ("source_id", "frame_index"), value: str = "pixels"
) -> DataFrame:
    """Add ``master`` to the pairs of every source whose pairs all have one; other sources give no rows.

    The guard is an aggregate with one row per source, so a source's frames are never gathered.
    """
    clip = [k for k in keys if k != "frame_index"]
    joined = _with_master(pairs, master, keys, value)
    gaps = joined.where(F.col("master").isNull()).select(*clip).distinct()
    return salted_join(joined, gaps, clip, "left_anti")


def compare_quality(
    pairs: DataFrame,
    master: DataFrame,
    keys: Sequence[str] = ("source_id", "frame_index"),
    value: str = "pixels",
    peak: float = 255.0,
    channels: int = 1,
) -> DataFrame:
    """Per source: candidate against reference, and each against the master when all masters exist.

    Every pair fans out to its comparisons in one pass; whether a source has all its masters comes out of the same
    partial aggregation that sums up the metrics.
    """
    clip = [k for k in keys if k != "frame_index"]

    def labelled(label: str, a: str, b: str) -> Column:
        return F.struct(F.lit(label).alias("comparison"), F.col(a).alias("reference"), F.col(b).alias("candidate"))

    fanned = (
        _with_master(pairs, master, keys, value)
        .withColumn("_complete", F.col("master").isNotNull())
        .withColumn(
            "_each",
            F.explode(
                F.array(
                    labelled("candidateVsReference", "reference", "candidate"),
                    labelled("referenceVsMaster", "master", "reference"),
                    labelled("candidateVsMaster", "master", "candidate"),
                )
            ),
        )
        .select(*clip, "_complete", "_each.*")
    )
    measured = frame_metrics(fanned, peak=peak, channels=channels)
    by = [*clip, "comparison"]
    summary = _metric_summary(measured.groupBy(*by), F.every("_complete").alias("_complete"))
    return summary.where(F.col("_complete") | (F.col("comparison") == "candidateVsReference")).drop("_complete")


def mask_coverage(masks: DataFrame, keys: Sequence[str] = ("source_id",), mask: str = "mask", pixels: str | None = None) -> DataFrame:
    """Frames with any masked pixel and masked share in percent, rounded to 4. ``mask`` is an array; above 0 is masked."""
    covered = F.size(F.filter(mask, lambda v: v > 0))
    area = F.col(pixels) if pixels else F.size(mask)
    return masks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(covered > 0).alias("masked_frames"),
        F.round(F.sum(covered) / F.greatest(F.lit(1), F.sum(area)) * 100.0, 4).alias("coverage_percent"),
    )


def masked_mean(difference: Column, mask: Column) -> Column:
    """Mean of ``difference`` where ``mask`` is above 0; null for an empty mask. One pass over the zipped arrays."""
    zipped = F.zip_with(difference, mask, lambda d, m: F.struct(d.alias("d"), (m > 0).alias("m")))
    folded = F.aggregate(
        zipped,
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(
            (acc["s"] + F.when(p["m"], p["d"]).otherwise(0.0)).alias("s"),
            (acc["n"] + F.when(p["m"], 1).otherwise(0)).alias("n"),
        ),
        lambda acc: F.try_divide(acc["s"], acc["n"].cast("double")),
    )
    return folded


def _abs_diff(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def masked_mae(df: DataFrame, frame: str = "pixels", clean: str = "clean", mask: str = "mask") -> DataFrame:
    """Add ``masked_mae`` per frame, 0 where nothing is masked."""
    value = masked_mean(_abs_diff(F.col(frame), F.col(clean)), F.col(mask))
    return df.withColumn("masked_mae", F.coalesce(value, F.lit(0.0)))


def masked_flicker(
    frames: DataFrame,
    keys: Sequence[str] = ("source_id",),
    frame_index: str = "frame_index",
    pixels: str = "pixels",
    mask: str = "mask",
) -> DataFrame:
    """Per clip: mean over consecutive frames of the mean change inside the union of both masks (0 if never masked)."""
    stepped = blocked_lag(
        frames.select(*keys, frame_index, pixels, mask),
        keys,
        [frame_index],
        index_block(frame_index, 4_096),
        {"_before": pixels, "_before_mask": mask},
    )
    union = F.zip_with("_before_mask", mask, lambda a, b: F.when((a > 0) | (b > 0), 1).otherwise(0))
    change = masked_mean(_abs_diff(F.col(pixels), F.col("_before")), union)
    return (
        stepped.select(*keys, F.when(F.col("_before").isNotNull(), change).alias("_change"))
        .groupBy(*keys)
        .agg(F.coalesce(F.avg("_change"), F.lit(0.0)).alias("masked_flicker"))
    )


def smooth_masks(
    masks: DataFrame, radius: int, keys: Sequence[str] = ("source_id",), frame_index: str = "frame_index", mask: str = "mask"
) -> DataFrame:
    """OR every dense mask (array, above 0 is set) with its neighbours within ``radius`` frames.

    A mask goes to the block of its frame, and to the next block only if it is within ``radius`` of the edge, so about one copy of
    each is shuffled and a task sorts the masks of one block.
    """
    if radius <= 0:
        return masks.select(*keys, frame_index, mask)
    i, step = F.col(frame_index).cast("bigint"), max(MASK_BLOCK, 2 * radius)
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((i - radius) / step))
    spread = masks.select(*keys, i.alias(frame_index), F.col(mask).alias("_mask"), F.explode(F.sequence(first, F.floor((i + radius) / step))).alias("_block"))
    near = Window.partitionBy(*keys, "_block").orderBy(frame_index).rangeBetween(-radius, radius)
    merged = F.reduce(
        "_masks",
        F.transform(F.col("_masks")[0], lambda v: F.lit(0)),
        lambda acc, m: F.zip_with(acc, m, lambda a, b: F.when((a > 0) | (b > 0), 1).otherwise(0)),
    )
    gathered = spread.withColumn("_masks", F.collect_list("_mask").over(near)).where(F.floor(F.col(frame_index) / step) == F.col("_block"))
    return gathered.select(*keys, frame_index, merged.alias(mask))


def pixel_arrays(frames: DataFrame, *columns: str) -> DataFrame:
    """The frames with BINARY columns of bytes (as the reader gives them) turned into arrays of numbers, for the array operators."""

    @F.arrow_udf("array<int>")
    def numbers(blobs: pa.Array) -> pa.Array:
        raw = [b or b"" for b in blobs.to_pylist()]
        ends = np.cumsum([0, *map(len, raw)], dtype=np.int32)
        values = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(raw), np.uint8).astype(np.int32))
        return pa.compute.if_else(blobs.is_valid(), values, pa.scalar(None, values.type)) if blobs.null_count else values

    return frames.withColumns({c: numbers(c) for c in columns})


def neighbour_union(
    mask_pixels: DataFrame,
    frames: DataFrame,
    radius: int,
    keys: Sequence[str] = ("source_id",),
    frame_index: str = "frame_index",
    pixel: str = "pixel_index",
) -> DataFrame:
    """Sparse form of :func:`smooth_masks`: ``mask_pixels`` has one row per masked pixel, ``frames`` lists the frames."""
    i = F.col(frame_index).cast("bigint")
    spread = (
        mask_pixels.select(*keys, pixel, F.explode(F.sequence(i - radius, i + radius)).alias(frame_index))
        .distinct()
    )
    return spread.join(frames.select(*keys, i.alias(frame_index)).distinct(), [*keys, frame_index], "left_semi")


def mask_bbox(
    mask_pixels: DataFrame,
    frames: DataFrame,
    padding: int = 28,
    keys: Sequence[str] = ("source_id", "frame_index"),
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Padded bounding box of the masked pixels per frame, clamped to the frame; the whole frame where none is masked.

    ``frames`` has ``keys, width, height``.
    """
    spans = mask_pixels.groupBy(*keys).agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")
    )
    zero = F.lit(0)
    return frames.join(spans, list(keys), "left").select(
        *keys,
        F.coalesce(F.greatest(zero, F.col("_x0") - padding), zero).alias("left"),
        F.coalesce(F.greatest(zero, F.col("_y0") - padding), zero).alias("top"),
        F.coalesce(F.least(F.col("width"), F.col("_x1") + padding + 1), F.col("width")).alias("right"),
        F.coalesce(F.least(F.col("height"), F.col("_y1") + padding + 1), F.col("height")).alias("bottom"),
    )


def tools_by_sample(
    summaries: DataFrame, tools: Sequence[str], base_tool: str, keys: Sequence[str] = ("sample_id",), strict: bool = False
) -> DataFrame:
    """One row per sample of ``base_tool`` and tool, missing tools kept with null values (``strict`` drops them).

    The tool list is exploded from a literal, so the plan is one equi-join.
    """
    values = [c for c in summaries.columns if c not in (*keys, "tool")]
    base = (
        summaries.where(F.col("tool") == base_tool)
        .select(*keys)
        .distinct()
        .withColumn("tool", F.explode(F.array(*[F.lit(t) for t in tools])))
    )
    side = summaries.select(*keys, "tool", *values, F.lit(True).alias("_found"))
    joined = base.join(side, [*keys, "tool"], "inner" if strict else "left")
    return joined.select(*keys, "tool", F.col("_found").isNull().alias("missing"), *values)


def tool_scorecard(
    runtimes: DataFrame, frames: DataFrame, tools: Sequence[str], base_tool: str, keys: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Per sample and tool: runtime, masked flicker and masked error against the clean frames, rounded to 3.

    ``runtimes``: ``sample_id, tool, seconds``; ``frames``: ``sample_id, tool, frame_index, pixels, mask, clean``.
    """
    by = [*keys, "tool"]
    flicker = masked_flicker(frames, by)
    error = masked_mae(frames).groupBy(*by).agg(F.avg("masked_mae").alias("_mae"))
    card = tools_by_sample(runtimes, tools, base_tool, keys, strict=True)
    return card.join(flicker, by, "left").join(error, by, "left").select(
        *by,
        F.round("seconds", 3).alias("runtime_seconds"),
        F.round(F.coalesce("masked_flicker", F.lit(0.0)), 3).alias("masked_flicker"),
        F.round("_mae", 3).alias("masked_mae"),
    )


# --- tile seams -----------------------------------------------------------------------------------------------------

SEAM_REACH, SEAM_GUARD = 8, 2
SEAM_MIN_EDGE, SEAM_MIN_RATIO, SEAM_MIN_EXCESS = 8.0, 2.8, 6.0
SEAM_SPACING, SEAM_LIMIT, SEAM_MIN_SIZE = 12, 4, 48


def local_seam_scores(df: DataFrame, profile: str = "profile") -> DataFrame:
    """Explode an edge profile into ``position, edge, local_median, ratio``.

    The median is over the values within 8 positions, leaving out 2 on each side; the ratio's denominator is at
    least 1. Medians of sliding windows run as numpy over Arrow batches, which is several times faster here than sorting
    a small array per position with higher-order functions.
    """
    kept = [c for c in df.columns if c != profile]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)
    schema += ", position int, edge double, local_median double, ratio double"

    def score(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            profiles = [np.asarray(p, dtype=float) for p in pdf[profile]]
            sizes = np.array([p.size for p in profiles], dtype=int)
            out = pdf[kept].loc[pdf.index.repeat(sizes)].reset_index(drop=True)
            edges = np.concatenate([*profiles, np.empty(0)])
            near = np.concatenate([*[_near_medians(p) for p in profiles], np.empty(0)])
            position = np.concatenate([*[np.arange(n) for n in sizes], np.empty(0, dtype=int)])
            scores = {"position": position, "edge": edges, "local_median": near, "ratio": edges / np.maximum(1.0, near)}
            yield pd.concat([out, pd.DataFrame(scores)], axis=1)

    return df.select(*kept, profile).mapInPandas(score, schema)


def _near_medians(values):
    """Median of the values 3 to 8 positions away, per position; of all values in reach where those are missing."""
    import numpy as np

    n = values.size
    if n == 0:
        return values
    offsets = np.r_[-SEAM_REACH:-SEAM_GUARD, SEAM_GUARD + 1 : SEAM_REACH + 1]
    at = np.arange(n)[:, None] + offsets[None, :]
    near = np.where((at >= 0) & (at < n), values[np.clip(at, 0, n - 1)], np.nan)
    bare = np.isnan(near).all(axis=1)
    if bare.any():
        whole = [np.median(values[max(0, i - SEAM_REACH) : i + SEAM_REACH + 1]) for i in np.flatnonzero(bare)]
        near[bare, 0] = whole
    return np.nanmedian(near, axis=1)


def find_tile_seams(profiles: DataFrame, keys: Sequence[str] = ("source_id", "frame_index")) -> DataFrame:
    """Frames with regular tile seams: ``labels`` such as ``row41:4.2x``.

    ``profiles`` has ``keys, row_profile, col_profile`` (see :func:`framelane.operators.apply.frame_profile`); the
    greedy choice of the strongest, well separated peaks runs inside Arrow batches, one row per frame.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in profiles.select(*keys).schema)
    schema += ", labels array<string>"

    def detect(batches):
        import pandas as pd

        for pdf in batches:
            labels = [_seam_labels(r, c) for r, c in zip(pdf["row_profile"], pdf["col_profile"])]
            out = pdf[list(keys)].assign(labels=pd.Series(labels, index=pdf.index, dtype=object))
            yield out[[bool(v) for v in labels]]

    return profiles.select(*keys, "row_profile", "col_profile").mapInPandas(detect, schema)


def _seam_labels(rows, cols) -> list[str]:
    import numpy as np

    rows, cols = np.asarray(rows, dtype=float), np.asarray(cols, dtype=float)
    if rows.size + 1 < SEAM_MIN_SIZE or cols.size + 1 < SEAM_MIN_SIZE:
        return []
    row_peaks, col_peaks = _seam_peaks(rows), _seam_peaks(cols)
    strong_columns = len(col_peaks) >= 3 and max(round(r, 1) for _, r in col_peaks) >= 6.0
    if len(row_peaks) < 2 and not strong_columns:
        return []
    return [f"row{i + 1}:{r:.1f}x" for i, r in row_peaks] + [f"col{i + 1}:{r:.1f}x" for i, r in col_peaks]


def _seam_peaks(values) -> list[tuple[int, float]]:
    """Up to four (index, ratio) peaks at least 12 apart, strongest first chosen, returned by position."""
    import numpy as np

    n = values.size
    index = np.arange(SEAM_REACH, max(SEAM_REACH, n - SEAM_REACH))
    if index.size == 0:
        return []
    median = _near_medians(values)[index]
    edge = values[index]
    ratio = edge / np.maximum(1.0, median)
    peak = (edge >= values[index - 1]) & (edge >= values[np.minimum(index + 1, n - 1)])
    keep = peak & (edge >= SEAM_MIN_EDGE) & (ratio >= SEAM_MIN_RATIO) & (edge - median >= SEAM_MIN_EXCESS)
    chosen: list[tuple[int, float]] = []
    for j in sorted(np.flatnonzero(keep), key=lambda j: (-edge[j], -index[j])):
        if all(abs(int(index[j]) - i) >= SEAM_SPACING for i, _ in chosen):
            chosen.append((int(index[j]), float(ratio[j])))
        if len(chosen) == SEAM_LIMIT:
            break
    return sorted(chosen)
