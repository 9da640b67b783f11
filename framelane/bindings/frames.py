"""Frame queries. Each embedding is an 8x8 single-channel frame; its label is the clip, in order of ``vec_id``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framelane.bindings.registry import ORACLES, query, result, stand_in, table
from framelane.operators import apply, captions, quality, tiled_components, tiled_metrics
from framelane.operators.ordered import blocked_row_number, index_block
from framelane.session import ensure_checkpoint_dir

EMB = """e AS (SELECT label AS source_id, vec_id, embedding,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings)"""


def clip_frames(spark, sf):
    """``source_id, frame_index (0-based), vec_id, pixels``."""
    base = table(spark, sf, "embeddings").select(F.col("label").alias("source_id"), "vec_id", "embedding")
    ids = base.select("source_id", "vec_id")  # numbered without the pixels
    numbered = blocked_row_number(ids, ["source_id"], ["vec_id"], index_block("vec_id"), "_rn")
    return base.join(numbered, ["source_id", "vec_id"]).select(
        "source_id", "vec_id", F.col("embedding").cast("array<double>").alias("pixels"), (F.col("_rn") - 1).alias("frame_index")
    )


def following(frames, step: int = 1):
    """The same frames under the index of the frame ``step`` before them."""
    return frames.withColumn("frame_index", F.col("frame_index") - step)


def masked(frames, threshold: float = 0.0):
    return frames.withColumn("mask", F.transform("pixels", lambda p: F.when(p > threshold, 1).otherwise(0)))


def consecutive(spark, sf):
    frames = clip_frames(spark, sf)
    return quality.pair_frames(frames, following(frames))


@query(
    "frame_pairs",
    f"""WITH {EMB} SELECT source_id, coalesce(a.i, b.i - 1) AS frame_index,
    CASE WHEN a.i IS NULL THEN 'missing reference' WHEN b.i IS NULL THEN 'missing candidate' ELSE 'paired' END AS outcome
    FROM (SELECT source_id, i, i AS k FROM e) a FULL JOIN (SELECT source_id, i, i - 1 AS k FROM e) b USING (source_id, k)""",
)
def frame_pairs(spark, sf):
    pairs, rejects = consecutive(spark, sf)
    keys = ["source_id", "frame_index"]
    return result(
        pairs.select(*keys, F.lit("paired").alias("outcome")).unionByName(
            rejects.select(*keys, F.col("reason").alias("outcome"))
        ),
        "source_id",
        "frame_index:i",
        "outcome",
    )


def _metric_sql(pairs: str, group: str) -> str:
    """Metrics of array pairs ``a``, ``b`` for peak 1.0, one row per ``group``."""
    return f"""px AS (SELECT {group}, CAST(unnest(a) AS DOUBLE) AS x, CAST(unnest(b) AS DOUBLE) AS y FROM {pairs}),
    mm AS (SELECT {group}, avg(abs(x - y)) AS mae, avg((x - y) * (x - y)) AS mse, max(abs(x - y)) AS mx,
      avg(x) AS ax, avg(y) AS ay, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cov FROM px GROUP BY ALL),
    fm AS (SELECT {group}, round(mae, 6) AS mean_absolute_error, round(sqrt(mse), 6) AS root_mean_squared_error,
      mx AS max_absolute_error, CASE WHEN mse <= 0 THEN 'inf'::DOUBLE ELSE round(-10 * log10(mse), 6) END AS psnr,
      round(least(1.0, greatest(0.0, ((2 * ax * ay + 0.0001) * (2 * cov + 0.0009))
        / ((ax * ax + ay * ay + 0.0001) * (vx + vy + 0.0009)))), 6) AS ssim FROM mm)"""


METRICS = ("mean_absolute_error", "root_mean_squared_error", "max_absolute_error", "psnr", "ssim")
PAIR_SQL = f"""WITH {EMB}, p AS (SELECT a.source_id, a.i AS frame_index, a.embedding AS a, b.embedding AS b
  FROM e a JOIN e b ON b.source_id = a.source_id AND b.i = a.i + 1)"""


@query(
    "frame_metrics",
    f"{PAIR_SQL}, {_metric_sql('p', 'source_id, frame_index')} SELECT source_id, CAST(frame_index AS BIGINT) AS frame_index, "
    + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
    + " FROM fm",
)
def frame_metrics(spark, sf):
    pairs, _ = consecutive(spark, sf)
    return result(
        quality.frame_metrics(pairs, peak=1.0), "source_id", "frame_index:i", *[f"{m}:d" for m in METRICS]
    )


@query("tiled_frame_metrics", ORACLES["frame_metrics"])
def tiled_frame_metrics(spark, sf):
    """Frames in tiles of 24 values that are scored apart and merged."""
    pairs, _ = consecutive(spark, sf)
    tile = lambda name, at: F.slice(name, at, F.lit(24)).alias(name)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("reference")), F.lit(24))
    tiles = pairs.select("source_id", "frame_index", F.explode(F.transform(starts, lambda at: F.struct(tile("reference", at), tile("candidate", at)))).alias("_t"))
    moments = tiled_metrics.tile_moments(tiles.select("source_id", "frame_index", "_t.*"))
    return result(tiled_metrics.merge_metrics(moments, peak=1.0), "source_id", "frame_index:i", *[f"{m}:d" for m in METRICS])


SUMMARY_SQL = """CAST(count(*) AS BIGINT) AS frame_count,
  round(avg(mean_absolute_error), 6) AS average_mean_absolute_error,
  round(avg(root_mean_squared_error), 6) AS average_root_mean_squared_error,
  coalesce(round(avg(psnr) FILTER (WHERE isfinite(psnr)), 6), 'inf'::DOUBLE) AS average_psnr,
  round(avg(ssim), 6) AS average_ssim, round(max(max_absolute_error), 6) AS max_absolute_error"""
SUMMARY = (
    "frame_count:i",
    "average_mean_absolute_error:d",
    "average_root_mean_squared_error:d",
    "average_psnr:d",
    "average_ssim:d",
    "max_absolute_error:d",
)


@query(
    "clip_quality",
    f"{PAIR_SQL}, {_metric_sql('p', 'source_id, frame_index')} SELECT source_id, {SUMMARY_SQL} FROM fm GROUP BY source_id",
)
def clip_quality(spark, sf):
    pairs, _ = consecutive(spark, sf)
    return result(
        quality.summarize_frame_metrics(quality.frame_metrics(pairs, peak=1.0), ["source_id"]), "source_id", *SUMMARY
    )


# A mirrored copy of each frame stands in for the master; odd clips lack the master of their first frame.
MASTER_SQL = f"""{PAIR_SQL}, t AS (SELECT source_id, frame_index, a, b, list_reverse(a) AS m FROM p),
  full_clips AS (SELECT * FROM t WHERE source_id % 2 = 0)"""


def _masters(frames):
    return frames.where("source_id % 2 = 0 OR frame_index > 0").withColumn("pixels", F.reverse("pixels"))


@query(
    "master_triples",
    f"""{MASTER_SQL} SELECT source_id, CAST(frame_index AS BIGINT) AS frame_index,
    round(CAST(m[1] AS DOUBLE), 6) AS master_first FROM full_clips""",
)
def master_triples(spark, sf):
    frames = clip_frames(spark, sf)
    pairs, _ = consecutive(spark, sf)
    out = quality.triple_with_master(pairs, _masters(frames))
    return result(
        out.withColumn("master_first", F.element_at("master", 1)), "source_id", "frame_index:i", "master_first:d"
    )


@query(
    "quality_comparison",
    f"""{MASTER_SQL}, c AS (
      SELECT source_id, frame_index, 'candidateVsReference' AS comparison, a, b FROM t
      UNION ALL SELECT source_id, frame_index, 'referenceVsMaster', m, a FROM full_clips
      UNION ALL SELECT source_id, frame_index, 'candidateVsMaster', m, b FROM full_clips),
    {_metric_sql('c', 'source_id, comparison, frame_index')}
    SELECT source_id, comparison, {SUMMARY_SQL} FROM fm GROUP BY source_id, comparison""",
)
def quality_comparison(spark, sf):
    frames = clip_frames(spark, sf)
    pairs, _ = consecutive(spark, sf)
    return result(
        quality.compare_quality(pairs, _masters(frames), peak=1.0), "source_id", "comparison", *SUMMARY
    )


PIX = f"""WITH {EMB}, px AS (SELECT source_id, i, unnest(range(64)) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM e)"""


@query(
    "mask_coverage",
    f"""{PIX}, f AS (SELECT source_id, i, sum(CASE WHEN v > 0.3 THEN 1 ELSE 0 END) AS c, count(*) AS n FROM px GROUP BY 1, 2)
    SELECT source_id, CAST(count(*) AS BIGINT) AS frames, CAST(count(*) FILTER (WHERE c > 0) AS BIGINT) AS masked_frames,
    round(sum(c) / greatest(1, sum(n)) * 100.0::DOUBLE, 4) AS coverage_percent FROM f GROUP BY 1""",
)
def mask_coverage(spark, sf):
    return result(
        quality.mask_coverage(masked(clip_frames(spark, sf), 0.3)),
        "source_id",
        "frames:i",
        "masked_frames:i",
        "coverage_percent:d4",
    )


@query(
    "masked_error",
    f"""WITH {EMB}, px AS (SELECT source_id, i, CAST(unnest(embedding) AS DOUBLE) AS v,
      CAST(unnest(list_reverse(embedding)) AS DOUBLE) AS c FROM e),
    f AS (SELECT source_id, i, coalesce(avg(abs(v - c)) FILTER (WHERE v > 0.3), 0.0) AS mae FROM px GROUP BY 1, 2)
    SELECT source_id, round(avg(mae), 6) AS masked_mae FROM f GROUP BY 1""",
)
def masked_error(spark, sf):
    frames = masked(clip_frames(spark, sf), 0.3).withColumn("clean", F.reverse("pixels"))
    out = quality.masked_mae(frames).groupBy("source_id").agg(F.avg("masked_mae").alias("masked_mae"))
    return result(out, "source_id", "masked_mae:d")


FLICKER = """fl AS (SELECT a.{k}, a.i, avg(abs(a.v - b.v)) FILTER (WHERE a.v > {t} OR b.v > {t}) AS c
  FROM px a JOIN px b ON b.source_id = a.source_id AND b.i = a.i - 1 AND b.p = a.p GROUP BY ALL)"""


@query(
    "masked_flicker",
    f"""{PIX}, {FLICKER.format(k='source_id', t=0.3)}
    SELECT source_id, round(coalesce(avg(c), 0.0), 6) AS masked_flicker FROM fl GROUP BY 1""",
)
def masked_flicker(spark, sf):
    return result(quality.masked_flicker(masked(clip_frames(spark, sf), 0.3)), "source_id", "masked_flicker:d")


SMOOTH_SQL = f"""{PIX}, m AS (SELECT source_id, i, p, v > 0.35 AS s FROM px),
  sm AS (SELECT source_id, i, p, bool_or(s) OVER (PARTITION BY source_id, p ORDER BY i
    RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM m)"""


@query(
    "smoothed_masks",
    f"""{SMOOTH_SQL} SELECT source_id, CAST(i AS BIGINT) AS frame_index, CAST(sum(s::INT) AS BIGINT) AS pixels,
    CAST(sum(s::INT * (p + 1)) AS BIGINT) AS checksum FROM sm GROUP BY 1, 2""",
)
def smoothed_masks(spark, sf):
    out = quality.smooth_masks(masked(clip_frames(spark, sf), 0.35), 2)
    zero = F.lit(0).cast("bigint")
    return result(
        out.withColumns(
            {
                "pixels": F.aggregate("mask", zero, lambda acc, v: acc + v),
                "checksum": F.aggregate(F.transform("mask", lambda v, p: v * (p + 1)), zero, lambda acc, v: acc + v),
            }
        ),
        "source_id",
        "frame_index:i",
        "pixels:i",
        "checksum:i",
    )


def _mask_pixels(frames, threshold):
    return (
        frames.select("source_id", "frame_index", F.posexplode("pixels").alias("pixel_index", "_v"))
        .where(F.col("_v") > threshold)
        .drop("_v")
    )


@query(
    "mask_neighbour_union",
    f"{SMOOTH_SQL} SELECT source_id, CAST(i AS BIGINT) AS frame_index, CAST(p AS BIGINT) AS pixel_index FROM sm WHERE s",
)
def mask_neighbour_union(spark, sf):
    frames = clip_frames(spark, sf)
    return result(
        quality.neighbour_union(_mask_pixels(frames, 0.35), frames, 2), "source_id", "frame_index:i", "pixel_index:i"
    )


@query(
    "mask_boxes",
    f"""{PIX}, s AS (SELECT source_id, i, min(p % 8) AS x0, max(p % 8) AS x1, min(p // 8) AS y0, max(p // 8) AS y1
      FROM px WHERE v > 0.3 GROUP BY 1, 2)
    SELECT e.source_id, CAST(e.i AS BIGINT) AS frame_index, CAST(coalesce(greatest(0, x0 - 2), 0) AS BIGINT) AS "left",
      CAST(coalesce(greatest(0, y0 - 2), 0) AS BIGINT) AS "top", CAST(coalesce(least(8, x1 + 3), 8) AS BIGINT) AS "right",
      CAST(coalesce(least(8, y1 + 3), 8) AS BIGINT) AS "bottom" FROM e LEFT JOIN s ON s.source_id = e.source_id AND s.i = e.i""",
)
def mask_boxes(spark, sf):
    frames = clip_frames(spark, sf)
    pixels = _mask_pixels(frames, 0.3).withColumns(
        {"x": F.col("pixel_index") % 8, "y": F.floor(F.col("pixel_index") / 8)}
    )
    sizes = frames.select("source_id", "frame_index", F.lit(8).alias("width"), F.lit(8).alias("height"))
    return result(
        quality.mask_bbox(pixels, sizes, padding=2), "source_id", "frame_index:i", "left:i", "top:i", "right:i", "bottom:i"
    )


@query(
    "seam_scores",
    """WITH v AS (SELECT label AS source_id, vec_id, CAST(unnest(range(64)) AS INT) AS i, abs(CAST(unnest(embedding) AS DOUBLE)) * 100 AS x FROM embeddings)
    SELECT a.source_id, a.vec_id, CAST(a.i AS BIGINT) AS position, round(any_value(a.x), 6) AS edge,
      round(median(b.x), 6) AS local_median, round(any_value(a.x) / greatest(1.0, median(b.x)), 6) AS ratio
    FROM v a JOIN v b ON b.vec_id = a.vec_id AND abs(b.i - a.i) BETWEEN 3 AND 8 GROUP BY 1, 2, 3""",
)
def seam_scores(spark, sf):
    profiles = table(spark, sf, "embeddings").select(
        F.col("label").alias("source_id"),
        "vec_id",
        F.transform("embedding", lambda v: F.abs(v.cast("double")) * 100).alias("profile"),
    )
    return result(
        quality.local_seam_scores(profiles),
        "source_id",
        "vec_id",
        "position:i",
        "edge:d",
        "local_median:d",
        "ratio:d",
    )


SEAM_SQL = """v AS (SELECT label AS source_id, vec_id AS frame_index, 'row' AS axis, CAST(unnest(range(64)) AS INT) AS i, abs(CAST(unnest(embedding) AS DOUBLE)) * 100 AS x FROM embeddings
    UNION ALL SELECT label, vec_id, 'col', CAST(unnest(range(64)) AS INT), abs(CAST(unnest(list_reverse(embedding)) AS DOUBLE)) * 100 FROM embeddings),
  md AS (SELECT a.source_id, a.frame_index, a.axis, a.i, median(b.x) AS m FROM v a JOIN v b ON b.frame_index = a.frame_index AND b.axis = a.axis
    AND abs(b.i - a.i) BETWEEN 3 AND 8 WHERE a.i BETWEEN 8 AND 55 GROUP BY ALL),
  nb AS (SELECT *, lag(x) OVER w AS bf, lead(x) OVER w AS af FROM v WINDOW w AS (PARTITION BY frame_index, axis ORDER BY i)),
  ca AS (SELECT nb.*, x / greatest(1.0, m) AS r FROM nb JOIN md USING (source_id, frame_index, axis, i)
    WHERE x >= bf AND x >= af AND x >= 8 AND x / greatest(1.0, m) >= 2.8 AND x - m >= 6),
  pk AS (SELECT source_id, frame_index, axis, list_reduce(list([i] ORDER BY x DESC, i DESC), lambda a, n: CASE WHEN len(a) < 4
    AND len(list_filter(a, lambda k: abs(k - n[1]) < 12)) = 0 THEN list_concat(a, n) ELSE a END) AS ks FROM ca GROUP BY 1, 2, 3),
  pe AS (SELECT ca.*, printf('%.1f', r) AS t FROM ca JOIN pk USING (source_id, frame_index, axis) WHERE list_contains(ks, i)),
  fr AS (SELECT source_id, frame_index, count(*) FILTER (WHERE axis = 'row') AS nr, count(*) FILTER (WHERE axis = 'col') AS nc,
    max(CAST(t AS DOUBLE)) FILTER (WHERE axis = 'col') AS mc, string_agg(axis || (i + 1) || ':' || t || 'x', ',' ORDER BY axis DESC, i) AS labels FROM pe GROUP BY 1, 2)"""


@query(
    "tile_seams",
    f"WITH {SEAM_SQL} SELECT source_id, frame_index, labels FROM fr WHERE nr >= 2 OR (nc >= 3 AND mc >= 6.0)",
)
def tile_seams(spark, sf):
    profiles = table(spark, sf, "embeddings").select(
        F.col("label").alias("source_id"),
        F.col("vec_id").alias("frame_index"),
        F.transform("embedding", lambda v: F.abs(v.cast("double")) * 100).alias("row_profile"),
        F.transform(F.reverse("embedding"), lambda v: F.abs(v.cast("double")) * 100).alias("col_profile"),
    )
    out = quality.find_tile_seams(profiles)
    return out.select("source_id", "frame_index", F.array_join("labels", ",").alias("labels"))


TOOLS = ("local", "lama", "inpaint")
TOOL_SQL = "CASE vec_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'lama' ELSE 'inpaint' END"


@query(
    "tools_by_sample",
    """WITH s AS (SELECT o_custkey AS sample_id, o_orderpriority AS tool, sum(o_orderkey) AS frames FROM orders GROUP BY 1, 2),
    base AS (SELECT sample_id, unnest(['1-URGENT', '3-MEDIUM', '5-LOW']) AS tool FROM s WHERE tool = '1-URGENT')
    SELECT base.sample_id, base.tool, s.tool IS NULL AS missing, CAST(s.frames AS BIGINT) AS frames
    FROM base LEFT JOIN s ON s.sample_id = base.sample_id AND s.tool = base.tool""",
)
def tools_by_sample(spark, sf):
    summaries = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("tool"))
        .agg(F.sum("o_orderkey").alias("frames"))
    )
    return quality.tools_by_sample(summaries, ("1-URGENT", "3-MEDIUM", "5-LOW"), "1-URGENT")


@query(
    "tool_scorecard",
    f"""WITH e AS (SELECT label AS source_id, {TOOL_SQL} AS tool, vec_id, embedding,
      row_number() OVER (PARTITION BY label, {TOOL_SQL} ORDER BY vec_id) AS k FROM embeddings),
    px AS (SELECT source_id, tool, k AS i, unnest(range(64)) AS p, CAST(unnest(embedding) AS DOUBLE) AS v,
      CAST(unnest(list_reverse(embedding)) AS DOUBLE) AS c FROM e),
    fl AS (SELECT a.source_id, a.tool, a.i, avg(abs(a.v - b.v)) FILTER (WHERE a.v > 0.2 OR b.v > 0.2) AS c
      FROM px a JOIN px b ON b.source_id = a.source_id AND b.tool = a.tool AND b.i = a.i - 1 AND b.p = a.p GROUP BY ALL),
    flicker AS (SELECT source_id, tool, coalesce(avg(c), 0.0) AS flicker FROM fl GROUP BY 1, 2),
    err AS (SELECT source_id, tool, avg(m) AS mae FROM (SELECT source_id, tool, i,
      coalesce(avg(abs(v - c)) FILTER (WHERE v > 0.2), 0.0) AS m FROM px GROUP BY ALL) GROUP BY 1, 2),
    run AS (SELECT source_id, tool, sum(vec_id) / 7.0::DOUBLE AS seconds FROM e GROUP BY 1, 2),
    base AS (SELECT DISTINCT source_id FROM e WHERE tool = 'local')
    SELECT run.source_id AS sample_id, run.tool, round(seconds, 3) AS runtime_seconds,
      round(coalesce(flicker, 0.0), 3) AS masked_flicker, round(mae, 3) AS masked_mae
    FROM run JOIN base USING (source_id) LEFT JOIN flicker USING (source_id, tool) LEFT JOIN err USING (source_id, tool)""",
)
def tool_scorecard(spark, sf):
    frames = table(spark, sf, "embeddings").select(
        F.col("label").alias("sample_id"),
        F.expr(TOOL_SQL).alias("tool"),
        F.col("vec_id").alias("frame_index"),
        F.col("embedding").cast("array<double>").alias("pixels"),
    )
    frames = masked(frames, 0.2).withColumn("clean", F.reverse("pixels"))
    runtimes = frames.groupBy("sample_id", "tool").agg((F.sum("frame_index") / 7.0).alias("seconds"))
    return quality.tool_scorecard(runtimes, frames, TOOLS, "local")


# --- byte frames ----------------------------------------------------------------------------------------------------

BYTES = """e AS (SELECT label AS source_id, [CAST(floor((CAST(v AS DOUBLE) + 1) * 100) AS DOUBLE) FOR v IN embedding] AS b,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings)"""


def read_back(spark, sf):
    """The frames as the reader gives them: width, height, channels and BINARY pixels."""
    levels = F.transform("pixels", lambda v: F.lpad(F.hex(F.floor((v + 1) * 100).cast("bigint")), 2, "0"))
    raw = F.unhex(F.array_join(levels, ""))
    shape = {"width": F.lit(8), "height": F.lit(8), "channels": F.lit(1)}
    return clip_frames(spark, sf).withColumns({"pixels": raw, **shape})


@query(
    "byte_frame_metrics",
    f"""WITH {BYTES}, px AS (SELECT a.source_id, a.i, unnest(a.b) AS x, unnest(n.b) AS y FROM e a JOIN e n ON n.source_id = a.source_id AND n.i = a.i + 1),
    mm AS (SELECT source_id, i, avg(abs(x - y)) AS mae, avg((x - y) * (x - y)) AS mse, max(abs(x - y)) AS mx, avg(x / 255) AS ax, avg(y / 255) AS ay,
      var_pop(x / 255) AS vx, var_pop(y / 255) AS vy, covar_pop(x / 255, y / 255) AS cov FROM px GROUP BY ALL)
    SELECT source_id, CAST(i AS BIGINT) AS frame_index, round(mae, 6) AS mean_absolute_error, round(sqrt(mse), 6) AS root_mean_squared_error, mx AS max_absolute_error,
      CASE WHEN mse <= 0 THEN 'inf'::DOUBLE ELSE round(20 * log10(255) - 10 * log10(mse), 6) END AS psnr,
      round(least(1.0, greatest(0.0, ((2 * ax * ay + 0.0001) * (2 * cov + 0.0009)) / ((ax * ax + ay * ay + 0.0001) * (vx + vy + 0.0009)))), 6) AS ssim FROM mm""",
)
def byte_frame_metrics(spark, sf):
    frames = read_back(spark, sf)
    pairs, _ = quality.pair_frames(frames, following(frames), shape=("width", "height", "channels"))
    return result(quality.binary_frame_metrics(pairs), "source_id", "frame_index:i", *[f"{m}:d" for m in METRICS])


@query(
    "byte_masked_error",
    f"""WITH {BYTES}, px AS (SELECT source_id, i, unnest(b) AS v, unnest(list_reverse(b)) AS c FROM e),
    f AS (SELECT source_id, i, count(*) FILTER (WHERE v > 130) AS m, coalesce(avg(abs(v - c)) FILTER (WHERE v > 130), 0.0) AS mae FROM px GROUP BY 1, 2)
    SELECT source_id, round(avg(mae), 6) AS masked_mae, CAST(sum(m) AS BIGINT) AS masked_pixels FROM f GROUP BY 1""",
)
def byte_masked_error(spark, sf):
    arrays = quality.pixel_arrays(read_back(spark, sf), "pixels")
    staged = masked(arrays, 130).withColumn("clean", F.reverse("pixels"))
    count = F.size(F.filter("mask", lambda m: m > 0))
    out = quality.masked_mae(staged).groupBy("source_id").agg(F.avg("masked_mae").alias("masked_mae"), F.sum(count).alias("masked_pixels"))
    return result(out, "source_id", "masked_mae:d", "masked_pixels:i")


# --- captions -------------------------------------------------------------------------------------------------------

COMPONENTS = """
CAST(floor(l_orderkey / 8) AS BIGINT) % 64 AS clip_id, CAST(floor(l_orderkey / 8) AS BIGINT) AS frame_index,
(l_partkey * 10 + l_linenumber) * 10000 + l_orderkey % 8 * 1000 + CAST(l_quantity AS BIGINT) AS component_id,
CAST(l_partkey * 7 % 1200 AS BIGINT) AS x, CAST(l_suppkey * 13 % 150 AS BIGINT) AS y,
CAST(floor(2 + l_quantity * (1 + l_linenumber) / 2) AS BIGINT) AS width,
CAST(3 + l_partkey % 23 AS BIGINT) AS height,
CAST(floor(1 + l_quantity * (3 + l_partkey % 23) / 3) AS BIGINT) AS area,
CAST(l_suppkey * 13 % 150 AS DOUBLE) + CAST(3 + l_partkey % 23 AS DOUBLE) / 2 + CAST(l_linenumber AS DOUBLE) / 16 AS center_y,
CAST(1280 AS BIGINT) AS roi_width, CAST(300 AS BIGINT) AS roi_height
"""
COMPONENT_SQL = f"c AS (SELECT {COMPONENTS} FROM lineitem)"
TEXT_SQL = f"""{COMPONENT_SQL}, g AS (SELECT * FROM c WHERE area BETWEEN 6 AND 17280 AND width >= 2 AND height BETWEEN 5 AND 105
    AND NOT (CAST(area AS DOUBLE) / greatest(1, width * height) > 0.9 AND width > 153.6)),
  r AS (SELECT a.clip_id, a.frame_index, a.component_id, a.center_y, greatest(10.0, a.height * 1.8::DOUBLE) AS tol,
      count(*) AS n, sum(b.area) AS area, max(b.x + b.width) - min(b.x) AS w
    FROM g a JOIN g b ON b.clip_id = a.clip_id AND b.frame_index = a.frame_index
      AND abs(b.center_y - a.center_y) <= greatest(10.0, a.height * 1.8::DOUBLE) GROUP BY ALL),
  pass AS (SELECT DISTINCT clip_id, frame_index, center_y, tol FROM r WHERE n >= 3 AND w >= 57 AND area <= 30720),
  kept AS (SELECT g.* FROM g WHERE
    (width >= 204 AND height BETWEEN 6 AND 48 AND CAST(area AS DOUBLE) / greatest(1, width * height) <= 0.72)
    OR EXISTS (SELECT 1 FROM pass p WHERE p.clip_id = g.clip_id AND p.frame_index = g.frame_index
      AND abs(g.center_y - p.center_y) <= p.tol))"""


def components(spark, sf):
    return stand_in(spark, sf, "lineitem", COMPONENTS)


@query(
    "caption_text_components",
    f"WITH {TEXT_SQL} SELECT clip_id, frame_index, component_id, x, width, area FROM kept",
)
def caption_text_components(spark, sf):
    return captions.filter_text_components(components(spark, sf)).select(
        "clip_id", "frame_index", "component_id", "x", "width", "area"
    )


PAD, GAP = 3, 60
BOX_SQL = f"""{COMPONENT_SQL}, k AS (SELECT * FROM c WHERE width > 0 AND height > 0 AND area > 0),
  band AS (SELECT a.clip_id, a.frame_index, a.component_id AS anchor, b.component_id, b.x, b.x + b.width AS r, b.y, b.y + b.height AS bt, b.width
    FROM k a JOIN k b ON b.clip_id = a.clip_id AND b.frame_index = a.frame_index
      AND abs(b.center_y - a.center_y) <= greatest(10.0, a.height * 1.8::DOUBLE)),
  st AS (SELECT *, CASE WHEN x - max(r) OVER (PARTITION BY clip_id, frame_index, anchor ORDER BY x, r, component_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {GAP} THEN 0 ELSE 1 END AS o FROM band),
  cl AS (SELECT *, sum(o) OVER (PARTITION BY clip_id, frame_index, anchor ORDER BY x, r, component_id ROWS UNBOUNDED PRECEDING) AS cid FROM st),
  box AS (SELECT clip_id, frame_index, anchor, cid, min(x) AS l, min(y) AS t, max(r) AS r, max(bt) AS b, count(*) AS n,
    bool_or(width >= 204) AS wide FROM cl GROUP BY ALL),
  acc AS (SELECT clip_id, frame_index, anchor, l, greatest(0, l - {PAD * 2}) AS x1, greatest(0, t - {PAD}) AS y1,
    least(1280, r + {PAD * 2}) AS x2, least(300, b + {PAD}) AS y2 FROM box WHERE (n >= 3 OR wide) AND r - l >= 57 AND b - t <= 54),
  boxes AS (SELECT clip_id, frame_index, x1, y1, x2, y2, min((anchor, l)) AS o FROM acc GROUP BY ALL)"""


@query(
    "caption_line_boxes",
    f"""WITH {BOX_SQL} SELECT clip_id, frame_index, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2,
    CAST(y2 AS BIGINT) AS y2, CAST(o[1] AS BIGINT) AS first_component, CAST(o[2] AS BIGINT) AS row_left FROM boxes""",
)
def caption_line_boxes(spark, sf):
    return result(
        captions.cluster_caption_lines(components(spark, sf), PAD, GAP),
        "clip_id",
        "frame_index",
        *[f"{c}:i" for c in ("x1", "y1", "x2", "y2", "first_component", "row_left")],
    )


@query(
    "caption_companions",
    f"""WITH {BOX_SQL}, m AS (SELECT k.*, b.x1, b.y1, b.x2, b.y2, row_number() OVER (PARTITION BY k.clip_id, k.frame_index, k.component_id
      ORDER BY o, x1, y1, x2, y2) AS rn FROM k JOIN boxes b ON b.clip_id = k.clip_id AND b.frame_index = k.frame_index
      AND CAST(round_even(k.center_y, 0) AS BIGINT) BETWEEN b.y1 - {PAD} AND b.y2 + {PAD}
      AND greatest(b.x1 - (k.x + k.width), k.x - b.x2, 0) <= 64)
    SELECT clip_id, frame_index, component_id, CAST(x1 AS BIGINT) AS box_x1, CAST(y1 AS BIGINT) AS box_y1, CAST(x2 AS BIGINT) AS box_x2, CAST(y2 AS BIGINT) AS box_y2,
      CAST(greatest(0, x - {PAD * 2}) AS BIGINT) AS "left", CAST(greatest(0, y - {PAD}) AS BIGINT) AS "top",
      CAST(least(1280, x + width + {PAD * 2}) AS BIGINT) AS "right", CAST(least(300, y + height + {PAD}) AS BIGINT) AS "bottom"
    FROM m WHERE rn = 1""",
)
def caption_companions(spark, sf):
    found = components(spark, sf)
    boxes = captions.cluster_caption_lines(found, PAD, GAP)
    names = ("box_x1", "box_y1", "box_x2", "box_y2", "left", "top", "right", "bottom")
    return result(
        captions.absorb_companions(found, boxes, PAD), "clip_id", "frame_index", "component_id", *[f"{c}:i" for c in names]
    )


# --- model functions ------------------------------------------------------------------------------------------------

PIXELS = "CAST(floor((CAST(v AS DOUBLE) + 0.7) * 180) AS BIGINT)"
BYTES_SQL = f"""{EMB.replace('e AS', 'e0 AS', 1)}, e AS (SELECT source_id, i, unnest(range(64)) AS p, unnest(embedding) AS v FROM e0),
  b AS (SELECT source_id, i, p, greatest(0, least(255, {PIXELS})) AS v FROM e)"""


def byte_frames(spark, sf):
    """The clips as 8-bit single-channel images."""
    frames = clip_frames(spark, sf)
    level = F.transform(
        "pixels", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v + 0.7) * 180))).cast("bigint")
    )
    text = F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    one = F.lit(8).cast("int")
    return frames.select(
        "source_id",
        F.col("frame_index").cast("int").alias("frame_index"),
        one.alias("width"),
        one.alias("height"),
        F.lit(1).cast("int").alias("channels"),
        F.unhex(text).alias("pixels"),
    )


def _sums(df, weight):
    """Plain and position-weighted sum of the pixels of each frame."""
    size = F.octet_length("pixels").cast("int")
    values = F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: F.conv(F.hex(F.substring("pixels", i + 1, F.lit(1))), 16, 10).cast("bigint")
    )
    zero = F.lit(0).cast("bigint")
    return df.select(
        "source_id",
        F.col("frame_index").cast("bigint").alias("frame_index"),
        F.aggregate(values, zero, lambda acc, v: acc + v).alias("total"),
        F.aggregate(F.transform(values, lambda v, i: v * (i % weight)), zero, lambda acc, v: acc + v).alias("weighted"),
    )


def _invert(frames):
    return [255 - f for f in frames]


@query(
    "model_framewise",
    f"""WITH {BYTES_SQL} SELECT source_id, CAST(i AS BIGINT) AS frame_index, CAST(sum(255 - v) AS BIGINT) AS total,
    CAST(sum((255 - v) * (p % 7)) AS BIGINT) AS weighted FROM b GROUP BY 1, 2""",
)
def model_framewise(spark, sf):
    return _sums(apply.apply_framewise(byte_frames(spark, sf), _invert), 7)


def _mean_of_five(frames):
    import numpy as np

    stack = np.stack([f.astype(float) for f in frames])
    ends = [(max(0, i - 2), i + 3) for i in range(len(frames))]
    return [np.rint(stack[a:b].mean(axis=0)).astype(np.uint8) for a, b in ends]


@query(
    "model_temporal",
    f"""WITH {BYTES_SQL}, m AS (SELECT source_id, i, p, CAST(round_even(avg(v) OVER (PARTITION BY source_id, p ORDER BY i
      RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS BIGINT) AS v FROM b)
    SELECT source_id, CAST(i AS BIGINT) AS frame_index, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (p % 7)) AS BIGINT) AS weighted FROM m GROUP BY 1, 2""",
)
def model_temporal(spark, sf):
    # radius 2 of context makes the chunked result equal to one pass over the whole clip
    return _sums(apply.apply_temporal(byte_frames(spark, sf), _mean_of_five, chunk=16, minimum=1), 7)


def _double(tiles):
    return [t.repeat(2, axis=0).repeat(2, axis=1) for t in tiles]


TILED_SQL = f"""WITH {BYTES_SQL} SELECT source_id, CAST(i AS BIGINT) AS frame_index, CAST(sum(v) * 4 AS BIGINT) AS total,
    CAST(sum(v * ((2 * (p // 8) * 16 + 2 * (p % 8)) % 5 + (2 * (p // 8) * 16 + 2 * (p % 8) + 1) % 5
      + ((2 * (p // 8) + 1) * 16 + 2 * (p % 8)) % 5 + ((2 * (p // 8) + 1) * 16 + 2 * (p % 8) + 1) % 5)) AS BIGINT) AS weighted FROM b GROUP BY 1, 2"""


@query("model_tiled_crop", TILED_SQL)
def model_tiled_crop(spark, sf):
    return _sums(apply.apply_tiled(byte_frames(spark, sf), _double, 3, scale=2), 5)


@query("model_tiled_average", TILED_SQL)
def model_tiled_average(spark, sf):
    return _sums(apply.apply_tiled(byte_frames(spark, sf), _double, 5, 2, "average", scale=2, spread=True), 5)


@query(
    "model_stages",
    f"""WITH {BYTES_SQL}, m AS (SELECT source_id, i, p, CAST(round_even(avg(v) OVER (PARTITION BY source_id, p ORDER BY i
      RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS BIGINT) AS v FROM b),
    c AS (SELECT source_id, count(DISTINCT i) AS n, sum(v) AS t FROM m GROUP BY 1)
    SELECT stage, source_id, CAST(n AS BIGINT) AS input_frames, CAST(n AS BIGINT) AS output_frames, n > 0 AS complete, CAST(t * k AS BIGINT) AS total
    FROM c, (VALUES ('denoise', 1), ('upscale', 4)) AS s(stage, k)""",
)
def model_stages(spark, sf):
    folder = f"{ensure_checkpoint_dir(spark)}/stages-{uuid.uuid4().hex}"
    _, reports = apply.run_stages(
        byte_frames(spark, sf),
        [
            ("denoise", lambda df: apply.apply_temporal(df, _mean_of_five, chunk=16, minimum=1)),
            ("colorize", None),
            ("upscale", lambda df: apply.apply_framewise(df, _double)),
        ],
        folder=folder,
    )
    out = None
    for stage, report in reports.items():
        pixels = _sums(spark.read.parquet(f"{folder}/{stage}"), 7).groupBy("source_id").agg(F.sum("total").alias("total"))
        part = report.join(pixels, "source_id").select(F.lit(stage).alias("stage"), "source_id", "input_frames", "output_frames", "complete", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "frame_profiles",
    f"""WITH {BYTES_SQL}, d AS (SELECT a.source_id, a.i, avg(a.v) AS luma, avg(abs(r.v - a.v)) AS down, avg(abs(c.v - a.v)) AS across FROM b a
      LEFT JOIN b r ON r.source_id = a.source_id AND r.i = a.i AND r.p = a.p + 8
      LEFT JOIN b c ON c.source_id = a.source_id AND c.i = a.i AND c.p = a.p + 1 AND a.p % 8 < 7 GROUP BY 1, 2)
    SELECT source_id, CAST(i AS BIGINT) AS frame_index, round(luma, 6) AS mean_luma, round(down, 6) AS row_step, round(across, 6) AS col_step FROM d""",
)
def frame_profiles(spark, sf):
    profiles = apply.frame_profile(byte_frames(spark, sf))

    def mean(name):
        return F.aggregate(name, F.lit(0.0), lambda acc, v: acc + v) / F.size(name)

    return result(
        profiles.withColumns({"row_step": mean("row_profile"), "col_step": mean("col_profile")}),
        "source_id",
        "frame_index:i",
        "mean_luma:d",
        "row_step:d",
        "col_step:d",
    )


@query(
    "caption_components",
    f"""WITH RECURSIVE {BYTES_SQL}, l AS (SELECT source_id, i, p, p // 8 - 5 AS y, p % 8 AS x FROM b WHERE v >= 150 AND p // 8 >= 5),
    re AS (SELECT source_id, i, p, p AS q FROM l UNION SELECT re.source_id, re.i, re.p, n.p FROM re JOIN l f ON f.source_id = re.source_id AND f.i = re.i AND f.p = re.q
      JOIN l n ON n.source_id = re.source_id AND n.i = re.i AND abs(n.y - f.y) <= 1 AND abs(n.x - f.x) <= 1),
    ro AS (SELECT source_id, i, p, min(q) AS root FROM re GROUP BY 1, 2, 3),
    co AS (SELECT source_id, i, root, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS n, avg(y) AS cy FROM ro JOIN l USING (source_id, i, p) GROUP BY 1, 2, 3)
    SELECT source_id, CAST(i AS BIGINT) AS frame_index, CAST(row_number() OVER (PARTITION BY source_id, i ORDER BY root) AS BIGINT) AS component_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y,
      CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, CAST(n AS BIGINT) AS area, round(cy, 6) AS center_y FROM co""",
)
def caption_components(spark, sf):
    frames = byte_frames(spark, sf)
    found = apply.detect_caption_components(frames, ("source_id", "frame_index"), light_threshold=150)
    whole = ("frame_index", "component_id", "x", "y", "width", "height", "area")
    return result(found, "source_id", *[f"{c}:i" for c in whole], "center_y:d")


MOSAIC = 128  # images in a row of the large picture


@query(
    "tiled_caption_components",
    f"""WITH RECURSIVE {BYTES_SQL}, s AS (SELECT source_id, CAST(ceil(count(DISTINCT i) / {MOSAIC}) AS BIGINT) * 8 AS h FROM b GROUP BY 1),
    g AS (SELECT source_id, CAST(round_even(h * (1.0::DOUBLE - 0.42::DOUBLE), 0) AS BIGINT) AS top FROM s),
    m AS (SELECT source_id, i % {MOSAIC} * 8 + p % 8 AS x, i // {MOSAIC} * 8 + p // 8 - top AS y FROM b JOIN g USING (source_id) WHERE v >= 135 AND i // {MOSAIC} * 8 + p // 8 >= top),
    c AS (SELECT source_id, a.x, a.y FROM m a JOIN m r USING (source_id) JOIN m d USING (source_id) JOIN m e USING (source_id)
      WHERE r.x = a.x + 1 AND r.y = a.y AND d.x = a.x AND d.y = a.y + 1 AND e.x = a.x + 1 AND e.y = a.y + 1),
    l AS (SELECT DISTINCT source_id, c.x + dx AS x, c.y + dy AS y, (c.y + dy) * {MOSAIC * 8} + c.x + dx AS p FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(dx, dy)),
    n AS (SELECT f.source_id, f.p, t.p AS q FROM l f, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS o(dy), l t
      WHERE t.source_id = f.source_id AND t.x = f.x + dx AND t.y = f.y + dy),
    re AS (SELECT source_id, p, p AS q FROM l UNION SELECT re.source_id, re.p, n.q FROM re JOIN n ON n.source_id = re.source_id AND n.p = re.q),
    ro AS (SELECT source_id, p, min(q) AS root FROM re GROUP BY 1, 2),
    co AS (SELECT source_id, root, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS n, avg(y) AS cy FROM ro JOIN l USING (source_id, p) GROUP BY 1, 2)
    SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY root) AS component_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y,
      CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, n AS area, round(cy, 6) AS center_y FROM co""",
)
def tiled_caption_components(spark, sf):
    """Every clip as one large picture, whose tiles are the clip's images."""
    images = byte_frames(spark, sf).withColumnRenamed("frame_index", "_i")
    high = images.groupBy("source_id").agg((F.ceil((F.max("_i") + 1) / MOSAIC) * 8).alias("frame_height"))
    tiles = images.join(high, "source_id").select(
        "source_id",
        F.lit(0).alias("frame_index"),
        F.lit(MOSAIC * 8).alias("frame_width"),
        "frame_height",
        (F.col("_i") % MOSAIC * 8).alias("x"),
        (F.floor(F.col("_i") / MOSAIC) * 8).alias("y"),
        *apply.FRAME_COLUMNS,
    )
    found = tiled_components.detect_tiled_components(tiles, light_threshold=135)
    return result(found, "source_id", *[f"{c}:i" for c in ("component_id", "x", "y", "width", "height", "area")], "center_y:d")
