"""Planning queries: framing, policies, segments, halos, chunks, tiles, timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.bindings.registry import ORACLES, query, result, stand_in
from framelane.functions.numeric import round_dimension
from framelane.plans import framing, segments, table_functions, tiles

SIZES = """
p_partkey AS source_id,
CAST(320 + p_size * 16 AS INT) AS source_width,
CAST(240 + p_partkey % 541 AS INT) AS source_height,
CASE p_partkey % 8 WHEN 0 THEN 'source' WHEN 1 THEN 'custom' WHEN 2 THEN '16:9' WHEN 3 THEN '4:3' WHEN 4 THEN 'wide'
  WHEN 5 THEN '0:5' WHEN 6 THEN '9:16' ELSE '2.35:1' END AS aspect_ratio_preset,
CAST(p_size % 5 AS INT) AS custom_aspect_width,
CAST(p_size % 3 AS INT) AS custom_aspect_height,
CASE p_partkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'width' WHEN 2 THEN 'height' ELSE 'preset' END AS resolution_basis,
CASE WHEN p_size % 4 > 0 THEN CAST(700 + p_partkey % 997 AS INT) END AS target_width,
CASE WHEN p_size % 3 > 0 THEN CAST(500 + p_partkey % 777 AS INT) END AS target_height,
CASE p_partkey % 3 WHEN 0 THEN 'preserveAspect4k' WHEN 1 THEN 'cropTo4k' ELSE 'native4x' END AS output_mode,
CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS DOUBLE) / 40 - 0.125 END AS crop_left,
CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 100 AS DOUBLE) / 64 - 0.25 END AS crop_top,
CASE WHEN p_partkey % 4 > 0 THEN CAST(1 + p_size AS DOUBLE) / 40 END AS crop_width,
CASE WHEN p_partkey % 4 > 0 AND p_size > 3 THEN CAST(1 + p_partkey % 90 AS DOUBLE) / 64 END AS crop_height
"""

CLIPS = """
c_custkey AS source_id,
CAST(c_custkey % 5000 AS BIGINT) AS frame_count,
CAST(CASE WHEN c_nationkey < 2 THEN 0 ELSE c_nationkey + 5 END AS DOUBLE) AS frame_rate,
CAST(CASE WHEN c_nationkey % 2 = 0 THEN 30 ELSE 60 END AS DOUBLE) AS output_rate
"""

#: Sources that one task plans, about; a source becomes tens to hundreds of rows, which the size of its table does not tell.
SOURCES_PER_TASK = 10_000


def spread(sources):
    """Deal few short source rows over tasks by their number before they are planned."""
    parts = max(1, -(-sources.count() // SOURCES_PER_TASK))
    return sources.repartition(parts) if parts > 1 else sources


ASPECT_SQL = f"""
WITH base AS (SELECT {SIZES} FROM part),
src AS (SELECT *, CAST(source_width AS DOUBLE) / source_height AS src_ratio,
  TRY_CAST(split_part(aspect_ratio_preset, ':', 1) AS DOUBLE) AS aw,
  TRY_CAST(split_part(aspect_ratio_preset, ':', 2) AS DOUBLE) AS ah FROM base),
aspect AS (SELECT *, CASE
  WHEN aspect_ratio_preset = 'source' THEN src_ratio
  WHEN aspect_ratio_preset = 'custom' THEN
    CASE WHEN custom_aspect_width > 0 AND custom_aspect_height > 0
      THEN CAST(custom_aspect_width AS DOUBLE) / custom_aspect_height ELSE src_ratio END
  WHEN aw > 0 AND ah > 0 THEN aw / ah ELSE src_ratio END AS aspect_ratio FROM src)
"""


def _canvas_sql(rnd: str) -> str:
    def dim(x: str) -> str:
        r = f"greatest(2, {rnd.format(x=x)})"
        return f"CAST({r} + ({r} % 2) AS BIGINT)"

    return f"""{ASPECT_SQL},
canvas AS (SELECT *,
  CASE WHEN resolution_basis = 'exact' AND target_width > 0 AND target_height > 0 THEN {dim('target_width')}
       WHEN resolution_basis = 'width' AND target_width > 0 THEN {dim('target_width')}
       WHEN resolution_basis = 'height' AND target_height > 0 THEN {dim('target_height * aspect_ratio')}
       WHEN target_width > 0 AND target_height IS NULL THEN {dim('target_width')}
       WHEN target_height > 0 AND target_width IS NULL THEN {dim('target_height * aspect_ratio')}
       WHEN output_mode = 'native4x' AND abs(aspect_ratio - src_ratio) < 0.0001 THEN {dim('source_width * 2')}
       WHEN aspect_ratio >= 1 THEN 3840 ELSE {dim('2160 * aspect_ratio')} END AS canvas_width,
  CASE WHEN resolution_basis = 'exact' AND target_width > 0 AND target_height > 0 THEN {dim('target_height')}
       WHEN resolution_basis = 'width' AND target_width > 0 THEN {dim('target_width / aspect_ratio')}
       WHEN resolution_basis = 'height' AND target_height > 0 THEN {dim('target_height')}
       WHEN target_width > 0 AND target_height IS NULL THEN {dim('target_width / aspect_ratio')}
       WHEN target_height > 0 AND target_width IS NULL THEN {dim('target_height')}
       WHEN output_mode = 'native4x' AND abs(aspect_ratio - src_ratio) < 0.0001 THEN {dim('source_height * 2')}
       WHEN aspect_ratio >= 1 THEN {dim('3840 / aspect_ratio')} ELSE 2160 END AS canvas_height
  FROM aspect)"""


HALF_EVEN = "CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT)"
HALF_UP = "CAST(floor(CAST({x} AS DOUBLE) + 0.5) AS BIGINT)"


def _sizes(spark, sf):
    return stand_in(spark, sf, "part", SIZES)


def _clips(spark, sf):
    return stand_in(spark, sf, "customer", CLIPS)


@query("aspect_ratio", f"{ASPECT_SQL} SELECT source_id, round(aspect_ratio, 6) AS aspect_ratio FROM aspect")
def aspect_ratio(spark, sf):
    return result(framing.resolve_aspect_ratio(_sizes(spark, sf)), "source_id", "aspect_ratio:d")


@query(
    "output_canvas",
    f"{_canvas_sql(HALF_EVEN)} SELECT source_id, round(aspect_ratio, 6) AS aspect_ratio, "
    "CAST(canvas_width AS BIGINT) AS canvas_width, CAST(canvas_height AS BIGINT) AS canvas_height FROM canvas",
)
def output_canvas(spark, sf):
    return result(
        framing.resolve_output_canvas(_sizes(spark, sf)), "source_id", "aspect_ratio:d", "canvas_width:i", "canvas_height:i"
    )


@query(
    "round_dimension",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 64 AS x FROM lineitem),
    r AS (SELECT *, greatest(2, CAST(round_even(x, 0) AS BIGINT)) AS e, greatest(2, CAST(floor(x + 0.5) AS BIGINT)) AS u
      FROM v)
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
      CAST(e + e % 2 AS BIGINT) AS worker_pixels, CAST(u + u % 2 AS BIGINT) AS preview_pixels FROM r""",
)
def dimension(spark, sf):
    df = stand_in(
        spark, sf, "lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 64 AS x"
    ).withColumns({"worker_pixels": round_dimension("x"), "preview_pixels": round_dimension("x", "half_up")})
    return result(
        df, "l_orderkey", "l_linenumber:i", "l_partkey", "l_suppkey", "worker_pixels:i", "preview_pixels:i"
    )


CROP_SQL = f"""{ASPECT_SQL},
given AS (SELECT *, crop_left IS NOT NULL AND crop_top IS NOT NULL AND crop_width IS NOT NULL
  AND crop_height IS NOT NULL AS has_crop, least(1.0, greatest(0.0, crop_width)) AS cw,
  least(1.0, greatest(0.0, crop_height)) AS ch FROM aspect),
crops AS (SELECT source_id, aspect_ratio, src_ratio,
  CASE WHEN has_crop THEN least(greatest(0.0, crop_left), greatest(0.0, 1.0 - cw)) END AS crop_left,
  CASE WHEN has_crop THEN least(greatest(0.0, crop_top), greatest(0.0, 1.0 - ch)) END AS crop_top,
  CASE WHEN has_crop THEN cw END AS crop_width, CASE WHEN has_crop THEN ch END AS crop_height,
  CASE WHEN abs(aspect_ratio - src_ratio) < 0.0001 OR aspect_ratio > src_ratio THEN 1.0
    ELSE aspect_ratio / src_ratio END AS default_width,
  CASE WHEN abs(aspect_ratio - src_ratio) < 0.0001 OR aspect_ratio <= src_ratio THEN 1.0
    ELSE src_ratio / aspect_ratio END AS default_height FROM given)"""


@query(
    "crop_rect",
    f"""{CROP_SQL} SELECT source_id, round(crop_left, 9) AS crop_left, round(crop_top, 9) AS crop_top,
    round(crop_width, 9) AS crop_width, round(crop_height, 9) AS crop_height,
    round((1.0 - default_width) / 2, 9) AS default_left, round((1.0 - default_height) / 2, 9) AS default_top,
    round(default_width, 9) AS default_width, round(default_height, 9) AS default_height FROM crops""",
)
def crop_rect(spark, sf):
    return result(
        framing.clamp_crop(framing.default_crop(_sizes(spark, sf))),
        "source_id",
        *[f"{p}_{q}:d9" for p in ("crop", "default") for q in ("left", "top", "width", "height")],
    )


def _dim_up(x: str) -> str:
    r = f"greatest(2, CAST(floor({x} + 0.5) AS BIGINT))"
    return f"({r} + {r} % 2)"


@query(
    "framing_plan",
    f"""{_canvas_sql(HALF_UP)},
    {CROP_SQL.split(ASPECT_SQL + ',')[1].strip()},
    joined AS (SELECT c.*, k.crop_left AS kl, k.crop_top AS kt, k.crop_width AS kw, k.crop_height AS kh,
      k.default_width AS dw, k.default_height AS dh FROM canvas c JOIN crops k USING (source_id)),
    eff AS (SELECT *, output_mode = 'cropTo4k' AS cropping,
      output_mode = 'native4x' AND abs(aspect_ratio - src_ratio) < 0.0001 AS native FROM joined),
    win AS (SELECT *, CASE WHEN cropping THEN coalesce(kl, (1.0 - dw) / 2) ELSE 0.0 END AS el,
      CASE WHEN cropping THEN coalesce(kt, (1.0 - dh) / 2) ELSE 0.0 END AS et,
      CASE WHEN cropping THEN coalesce(kw, dw) ELSE 1.0 END AS ew,
      CASE WHEN cropping THEN coalesce(kh, dh) ELSE 1.0 END AS eh,
      least(CAST(canvas_width AS DOUBLE) / source_width, CAST(canvas_height AS DOUBLE) / source_height) AS fit FROM eff)
    SELECT source_id, CAST(canvas_width AS BIGINT) AS canvas_width, CAST(canvas_height AS BIGINT) AS canvas_height,
      CAST(CASE WHEN native THEN canvas_width ELSE {_dim_up(
        'source_width * (CASE WHEN cropping THEN canvas_width / (source_width * ew) ELSE fit END)')} END AS BIGINT) AS scaled_width,
      CAST(CASE WHEN native THEN canvas_height ELSE {_dim_up(
        'source_height * (CASE WHEN cropping THEN canvas_height / (source_height * eh) ELSE fit END)')} END AS BIGINT) AS scaled_height,
      CAST(CASE WHEN native THEN source_width ELSE least(source_width, {_dim_up('source_width * ew')}) END AS BIGINT) AS window_width,
      CAST(CASE WHEN native THEN source_height ELSE least(source_height, {_dim_up('source_height * eh')}) END AS BIGINT) AS window_height,
      CAST(CASE WHEN native THEN 0 ELSE floor(source_width * el + 0.5) END AS BIGINT) AS offset_x,
      CAST(CASE WHEN native THEN 0 ELSE floor(source_height * et + 0.5) END AS BIGINT) AS offset_y FROM win""",
)
def framing_plan(spark, sf):
    return result(
        framing.plan_framing(_sizes(spark, sf)),
        "source_id",
        *[f"{c}:i" for c in ("canvas_width", "canvas_height", "scaled_width", "scaled_height")],
        *[f"{c}:i" for c in ("window_width", "window_height", "offset_x", "offset_y")],
    )


@query(
    "required_scale",
    f"""{_canvas_sql(HALF_EVEN)} SELECT source_id, CAST(CASE WHEN output_mode = 'preserveAspect4k'
      THEN greatest(2, least(4, ceil(least(CAST(canvas_width AS DOUBLE) / source_width,
        CAST(canvas_height AS DOUBLE) / source_height) - 0.0001))) ELSE 4 END AS BIGINT) AS scale FROM canvas""",
)
def required_scale(spark, sf):
    return result(
        framing.required_scale(framing.resolve_output_canvas(_sizes(spark, sf))), "source_id", "scale:i"
    )


POLICY = """
p_partkey AS request_id,
CASE p_size % 4 WHEN 0 THEN 'pytorch-image-sr' WHEN 1 THEN 'pytorch-video-sr' WHEN 2 THEN 'realesrgan-ncnn'
  ELSE 'pytorch-image-denoise' END AS backend_id,
CASE p_partkey % 3 WHEN 0 THEN 'qualityMax' WHEN 1 THEN 'qualityBalanced' ELSE 'vramSafe' END AS quality_preset,
CASE WHEN p_partkey % 7 = 0 THEN p_size * 8 ELSE 0 END AS tile_size,
CASE p_partkey % 11 WHEN 0 THEN ' FP16 ' WHEN 1 THEN 'bf16' WHEN 2 THEN '  ' END AS precision,
p_partkey % 11 = 5 AS fp16, p_partkey % 11 = 6 AS bf16
"""


@query(
    "quality_policy",
    f"""WITH r AS (SELECT {POLICY} FROM part), e AS (SELECT *, nullif(lower(trim(precision)), '') AS named FROM r),
    x AS (SELECT *, fp16 OR bf16 OR named IS NOT NULL AS explicit FROM e)
    SELECT request_id, CAST(CASE WHEN tile_size > 0 THEN tile_size
        WHEN backend_id = 'pytorch-image-sr' THEN CASE quality_preset WHEN 'qualityMax' THEN 512 WHEN 'qualityBalanced' THEN 384 ELSE 256 END
        WHEN backend_id = 'pytorch-video-sr' THEN CASE quality_preset WHEN 'qualityMax' THEN 256 WHEN 'qualityBalanced' THEN 192 ELSE 128 END
        ELSE CASE quality_preset WHEN 'qualityMax' THEN 0 WHEN 'qualityBalanced' THEN 256 ELSE 128 END END AS BIGINT) AS effective_tile_size,
      CASE WHEN explicit THEN coalesce(named, CASE WHEN fp16 THEN 'fp16' ELSE 'bf16' END) END AS requested_precision,
      CASE WHEN explicit THEN coalesce(named, CASE WHEN fp16 THEN 'fp16' ELSE 'bf16' END)
        WHEN backend_id IN ('pytorch-image-sr', 'pytorch-video-sr') THEN
          CASE quality_preset WHEN 'qualityMax' THEN 'fp32' WHEN 'qualityBalanced' THEN 'bf16' ELSE 'fp16' END
        ELSE 'fp32' END AS selected_precision,
      CASE WHEN explicit THEN 'explicit-request'
        WHEN backend_id IN ('pytorch-image-sr', 'pytorch-video-sr') THEN 'preset-default' ELSE 'backend-fixed' END AS precision_source
    FROM x""",
)
def quality_policy(spark, sf):
    return result(
        framing.quality_policy(stand_in(spark, sf, "part", POLICY)),
        "request_id",
        "effective_tile_size:i",
        "requested_precision",
        "selected_precision",
        "precision_source",
    )


PREVIEW = """
c_custkey AS source_id, CAST(c_nationkey AS DOUBLE) * 1.25 AS frame_rate,
CAST(c_custkey % 900 AS DOUBLE) / 8 AS duration_seconds, c_custkey % 4 > 0 AS preview_mode,
CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 13 AS DOUBLE) / 4 - 0.5 END AS preview_duration_seconds,
CASE WHEN c_custkey % 6 > 0 THEN CAST(c_custkey % 1000 AS DOUBLE) / 7 - 1 END AS preview_start_offset_seconds
"""


@query(
    "preview_window",
    f"""WITH s AS (SELECT {PREVIEW} FROM customer),
    t AS (SELECT *, frame_rate > 0 AND duration_seconds > 0 AS usable,
      greatest(1, CAST(round_even(frame_rate * duration_seconds, 0) AS BIGINT)) AS total FROM s),
    f AS (SELECT *, CASE WHEN usable AND preview_mode AND preview_start_offset_seconds > 0 THEN
      least(total - 1, greatest(0, CAST(ceil(least(preview_start_offset_seconds, duration_seconds) * frame_rate - 1e-9) AS BIGINT)))
      ELSE 0 END AS start_frame FROM t),
    g AS (SELECT *, CASE WHEN NOT usable THEN 1 WHEN NOT preview_mode THEN total ELSE
      least(greatest(1, total - start_frame), greatest(1, CAST(round_even(frame_rate *
        CASE WHEN preview_duration_seconds > 0 THEN preview_duration_seconds ELSE 8.0 END, 0) AS BIGINT))) END AS window_frames FROM f)
    SELECT source_id, CAST(start_frame AS BIGINT) AS start_frame, CAST(window_frames AS BIGINT) AS window_frames,
      round(CASE WHEN usable THEN start_frame / frame_rate ELSE 0.0 END, 6) AS start_seconds,
      round(CASE WHEN NOT usable THEN 0.0 WHEN NOT preview_mode THEN duration_seconds ELSE window_frames / frame_rate END, 6) AS window_seconds
    FROM g""",
)
def preview_window(spark, sf):
    return result(
        framing.preview_window(stand_in(spark, sf, "customer", PREVIEW)),
        "source_id",
        "start_frame:i",
        "window_frames:i",
        "start_seconds:d",
        "window_seconds:d",
    )


MEDIA = """
p_partkey AS source_id, CAST(p_size * 16 - 16 AS INT) AS width, CAST(p_partkey % 721 AS INT) AS height,
CAST(p_size % 7 AS DOUBLE) * 10 AS frame_rate
"""


@query(
    "media_summary",
    f"""WITH m AS (SELECT {MEDIA} FROM part)
    SELECT source_id, round(CASE WHEN height <> 0 THEN CAST(width AS DOUBLE) / height ELSE 0.0 END, 6) AS aspect_ratio,
      CAST(width * height AS BIGINT) AS pixel_count,
      round(CASE WHEN width * height > 0 AND frame_rate > 0 THEN width * height * frame_rate END, 6) AS pixels_per_second,
      CASE WHEN width > 0 AND height > 0 THEN (width // gcd(width, height)) || ':' || (height // gcd(width, height))
        ELSE 'Unknown' END AS ratio_label FROM m""",
)
def media_summary(spark, sf):
    return result(
        framing.media_summary(stand_in(spark, sf, "part", MEDIA)),
        "source_id",
        "aspect_ratio:d",
        "pixel_count:i",
        "pixels_per_second:d",
        "ratio_label",
    )


EVENTS_SRC = """
c_custkey AS media_id, CAST(c_custkey % 60 AS DOUBLE) / 2 - 1 AS duration_seconds,
CAST(c_nationkey - 1 AS DOUBLE) / 8 AS interval_seconds
"""


@query(
    "expected_event_times",
    f"""WITH m AS (SELECT {EVENTS_SRC} FROM customer),
    e AS (SELECT *, unnest(generate_series(0, CAST(floor(duration_seconds / interval_seconds) AS BIGINT))) AS k
      FROM m WHERE duration_seconds > 0 AND interval_seconds > 0)
    SELECT media_id, CAST(k AS BIGINT) AS event_index, round(k * interval_seconds, 6) AS event_seconds FROM e
    WHERE round(k * interval_seconds, 6) < duration_seconds""",
)
def expected_event_times(spark, sf):
    return result(
        segments.event_times(stand_in(spark, sf, "customer", EVENTS_SRC)), "media_id", "event_index:i", "event_seconds:d"
    )


SEGMENTS_SQL = f"""
WITH clips AS (SELECT {CLIPS} FROM customer),
len AS (SELECT source_id, frame_count AS total_frames, output_rate,
  CASE WHEN frame_rate > 0 THEN frame_rate ELSE 1.0 END AS fps FROM clips WHERE frame_count > 0),
step AS (SELECT *, greatest(1, least(greatest(48, CAST(round_even(fps * 10, 0) AS BIGINT)), total_frames)) AS segment_frames FROM len),
seg AS (SELECT *, unnest(range(0, total_frames, segment_frames)) AS start_frame FROM step),
plan AS (SELECT *, start_frame // segment_frames AS segment_index,
  least(segment_frames, total_frames - start_frame) AS frame_count,
  CAST(ceil(total_frames / segment_frames) AS BIGINT) AS segment_count FROM seg)
"""


@query(
    "segment_plan",
    f"""{SEGMENTS_SQL} SELECT source_id, CAST(segment_index AS BIGINT) AS segment_index,
    CAST(start_frame AS BIGINT) AS start_frame, CAST(frame_count AS BIGINT) AS frame_count,
    round(start_frame / fps, 6) AS start_seconds, round(frame_count / fps, 6) AS duration_seconds FROM plan""",
)
def segment_plan(spark, sf):
    return result(
        segments.plan_segments(_clips(spark, sf)),
        "source_id",
        "segment_index:i",
        "start_frame:i",
        "frame_count:i",
        "start_seconds:d",
        "duration_seconds:d",
    )


OUT_SQL = """greatest({n}, CAST(round_even((({s}) + ({n})) * output_rate / fps, 0) AS BIGINT)
  - CAST(round_even(({s}) * output_rate / fps, 0) AS BIGINT))"""


@query(
    "output_frame_count",
    f"""{SEGMENTS_SQL} SELECT source_id, CAST(segment_index AS BIGINT) AS segment_index,
    CAST({OUT_SQL.format(s='start_frame', n='frame_count')} AS BIGINT) AS output_count,
    {OUT_SQL.format(s='start_frame', n='frame_count')} <= frame_count AS skipped FROM plan""",
)
def output_frames(spark, sf):
    plan = _plans(spark, sf).withColumn(
        "output_count", segments.output_frame_count("start_frame", "frame_count", "fps", "output_rate")
    )
    return result(
        plan.withColumn("skipped", segments.skip_interpolation("frame_count", "output_count")),
        "source_id",
        "segment_index:i",
        "output_count:i",
        "skipped",
    )


def _plans(spark, sf):
    clips = _clips(spark, sf).withColumn("fps", F.expr("CASE WHEN frame_rate > 0 THEN frame_rate ELSE 1.0D END"))
    return segments.plan_segments(clips, keys=("source_id", "fps", "output_rate"))


HALO_SQL = f"""{SEGMENTS_SQL},
halo AS (SELECT *, greatest(0, start_frame - CASE WHEN segment_index > 0 THEN 1 ELSE 0 END) AS es,
  least(total_frames, start_frame + frame_count + CASE WHEN segment_index < segment_count - 1 THEN 1 ELSE 0 END) AS ee FROM plan),
hp AS (SELECT source_id, segment_index, segment_count, start_frame, frame_count, fps, output_rate, es AS expanded_start,
  greatest(1, ee - es) AS expanded_count, start_frame - es AS overlap_before,
  greatest(0, ee - (start_frame + frame_count)) AS overlap_after,
  greatest(0, CAST(round_even(start_frame * (output_rate / fps), 0) AS BIGINT)
    - CAST(round_even(es * (output_rate / fps), 0) AS BIGINT)) AS output_start,
  {OUT_SQL.format(s='start_frame', n='frame_count')} AS output_count,
  {OUT_SQL.format(s='es', n='greatest(1, ee - es)')} AS expanded_output_count FROM halo)"""
HALO_COLUMNS = (
    "start_frame",
    "frame_count",
    "expanded_start",
    "expanded_count",
    "overlap_before",
    "overlap_after",
    "output_start",
    "output_count",
    "expanded_output_count",
)


@query(
    "halo_plan",
    f"{HALO_SQL} SELECT source_id, CAST(segment_index AS BIGINT) AS segment_index, "
    + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in HALO_COLUMNS)
    + ", round(expanded_start / fps, 6) AS expanded_start_seconds, round(expanded_count / fps, 6) AS expanded_seconds FROM hp",
)
def halo_plan(spark, sf):
    return result(
        segments.plan_halos(_plans(spark, sf), "fps", "output_rate"),
        "source_id",
        "segment_index:i",
        *[f"{c}:i" for c in HALO_COLUMNS],
        "expanded_start_seconds:d",
        "expanded_seconds:d",
    )


READ = "greatest(0, expanded_count - CASE WHEN (source_id + segment_index) % 3 = 0 THEN source_id % 40 ELSE 0 END)"


@query(
    "shrink_last_segment",
    f"""{HALO_SQL},
    act AS (SELECT *, CASE WHEN (source_id + segment_index) % 17 <> 4 THEN {READ} END AS actual FROM hp),
    ok AS (SELECT *, coalesce(actual = expanded_count, FALSE) AS same,
      coalesce(actual < expanded_count AND segment_index = segment_count - 1 AND actual > overlap_before, FALSE) AS short FROM act),
    fit AS (SELECT *, greatest(1, actual - overlap_before) AS fewer FROM ok)
    SELECT source_id, CAST(segment_index AS BIGINT) AS segment_index,
      CASE WHEN same OR short THEN 'accepted' ELSE 'expected ' || expanded_count || ' frames, read ' || coalesce(CAST(actual AS VARCHAR), 'none') END AS outcome,
      CAST(CASE WHEN short THEN fewer WHEN same THEN frame_count END AS BIGINT) AS frame_count,
      CAST(CASE WHEN same OR short THEN actual END AS BIGINT) AS expanded_count,
      CAST(CASE WHEN short THEN {OUT_SQL.format(s='start_frame', n='fewer')} WHEN same THEN output_count END AS BIGINT) AS output_count,
      CAST(CASE WHEN short THEN {OUT_SQL.format(s='expanded_start', n='actual')} WHEN same THEN expanded_output_count END AS BIGINT) AS expanded_output_count,
      CAST(CASE WHEN short THEN least(overlap_before, greatest(0, actual - 1)) WHEN same THEN overlap_before END AS BIGINT) AS overlap_before
    FROM fit""",
)
def shrink_last_segment(spark, sf):
    plans = segments.plan_halos(_plans(spark, sf), "fps", "output_rate")
    actual = plans.where("(source_id + segment_index) % 17 <> 4").select(
        "source_id", "segment_index", F.expr(READ).alias("actual_count")
    )
    accepted, rejected = segments.shrink_last_segment(plans, actual, "fps", "output_rate")
    columns = ("frame_count", "expanded_count", "output_count", "expanded_output_count", "overlap_before")
    kept = accepted.select(
        "source_id", "segment_index", F.lit("accepted").alias("outcome"), *[F.col(c).cast("bigint") for c in columns]
    )
    dropped = rejected.select(
        "source_id", "segment_index", F.col("error").alias("outcome"), *[F.lit(None).cast("bigint").alias(c) for c in columns]
    )
    return kept.unionByName(dropped)


CHUNK_COLUMNS = ("chunk_start", "chunk_end", "expanded_start", "expanded_end", "trim_start", "trim_end", "pad_frames")


@query(
    "temporal_chunks",
    f"""WITH clips AS (SELECT {CLIPS} FROM customer),
    c AS (SELECT source_id, frame_count AS n, unnest(range(0, frame_count, 32)) AS chunk_start FROM clips WHERE frame_count > 0),
    e AS (SELECT *, least(n, chunk_start + 32) AS chunk_end, greatest(0, chunk_start - 2) AS expanded_start FROM c),
    x AS (SELECT *, least(n, chunk_end + 2) AS expanded_end FROM e),
    t AS (SELECT *, chunk_start - expanded_start AS trim_start, chunk_end - expanded_start AS trim_end,
      greatest(0, 5 - (expanded_end - expanded_start)) AS pad_frames FROM x)
    SELECT source_id, CAST(chunk_start // 32 AS BIGINT) AS chunk_index,
    {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in CHUNK_COLUMNS)} FROM t""",
)
def temporal_chunks(spark, sf):
    return result(
        segments.plan_temporal_chunks(_clips(spark, sf)), "source_id", "chunk_index:i", *[f"{c}:i" for c in CHUNK_COLUMNS]
    )


TILE_SRC = "p_partkey AS source_id, CAST(p_size * 16 AS INT) AS width, CAST(16 + p_partkey % 721 AS INT) AS height"
TILE_COLUMNS = ("top", "left", "bottom", "right", "crop_top", "crop_left", "crop_bottom", "crop_right")


def _tile_select(extra: str = "") -> str:
    return "SELECT source_id, " + ", ".join(f'CAST("{c}" AS BIGINT) AS "tile_{c}"' for c in TILE_COLUMNS) + extra


def _tile_result(df):
    return df.select("source_id", *[F.col(c).cast("bigint").alias(f"tile_{c}") for c in TILE_COLUMNS])


@query(
    "tile_plan_crop",
    f"""WITH s AS (SELECT {TILE_SRC} FROM part), w AS (SELECT *, width <= 256 AND height <= 256 AS whole FROM s),
    t AS (SELECT *, unnest(CASE WHEN whole THEN [0] ELSE range(0, height, 256) END) AS crop_top FROM w),
    l AS (SELECT *, unnest(CASE WHEN whole THEN [0] ELSE range(0, width, 256) END) AS crop_left FROM t),
    b AS (SELECT *, least(height, crop_top + 256) AS crop_bottom, least(width, crop_left + 256) AS crop_right FROM l),
    h AS (SELECT *, greatest(0, crop_top - 32) AS "top", greatest(0, crop_left - 32) AS "left",
      least(height, crop_bottom + 32) AS "bottom", least(width, crop_right + 32) AS "right" FROM b)
    {_tile_select()} FROM h""",
)
def tile_plan_crop(spark, sf):
    return _tile_result(tiles.plan_tiles(spread(stand_in(spark, sf, "part", TILE_SRC)), 256))


@query(
    "tile_plan_average",
    f"""WITH s AS (SELECT {TILE_SRC} FROM part),
    p AS (SELECT *, width + (8 - width % 8) % 8 AS pw, height + (8 - height % 8) % 8 AS ph FROM s),
    k AS (SELECT *, pw <= 200 AND ph <= 200 AS whole, greatest(8, least(200, ph, pw) - least(200, ph, pw) % 8) AS tile FROM p),
    o AS (SELECT *, greatest(8, tile - least(24, greatest(0, tile - 8))) AS step FROM k),
    t AS (SELECT *, unnest(CASE WHEN whole THEN [0] ELSE list_distinct(list_append(range(0, greatest(1, ph - tile), step), greatest(0, ph - tile))) END) AS "top" FROM o),
    l AS (SELECT *, unnest(CASE WHEN whole THEN [0] ELSE list_distinct(list_append(range(0, greatest(1, pw - tile), step), greatest(0, pw - tile))) END) AS "left" FROM t),
    b AS (SELECT *, CASE WHEN whole THEN ph ELSE "top" + tile END AS "bottom", CASE WHEN whole THEN pw ELSE "left" + tile END AS "right" FROM l),
    h AS (SELECT *, least(height, "top") AS crop_top, least(width, "left") AS crop_left,
      least(height, "bottom") AS crop_bottom, least(width, "right") AS crop_right FROM b)
    {_tile_select()} FROM h""",
)
def tile_plan_average(spark, sf):
    return _tile_result(
        tiles.plan_tiles(spread(stand_in(spark, sf, "part", TILE_SRC)), 200, overlap=24, mode="average", multiple=8)
    )


FRAMES = """
l_orderkey % 97 AS source_id, l_orderkey AS frame_index, l_linenumber AS item, l_partkey AS payload,
l_suppkey AS payload2
"""


@query(
    "segment_assignment",
    f"""WITH f AS (SELECT {FRAMES} FROM lineitem), s AS (SELECT *, unnest(range(greatest(0, CAST(floor((frame_index - 2) / 240) AS BIGINT)),
      CAST(floor((frame_index + 2) / 240) AS BIGINT) + 1)) AS segment_index FROM f)
    SELECT source_id, CAST(segment_index AS BIGINT) AS segment_index, CAST(count(*) AS BIGINT) AS frames,
      CAST(count(*) FILTER (WHERE segment_index = frame_index // 240) AS BIGINT) AS core_frames,
      CAST(sum(payload) AS BIGINT) AS payload FROM s GROUP BY ALL""",
)
def segment_assignment(spark, sf):
    frames = segments.assign_frames_to_segments(stand_in(spark, sf, "lineitem", FRAMES), 240, halo=2)
    return frames.groupBy("source_id", "segment_index").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if("is_core").alias("core_frames"), F.sum("payload").alias("payload")
    )


@query(
    "sampled_frames",
    """WITH f AS (SELECT user_id AS source_id, event_id AS frame_index,
      (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS frame_seconds, value FROM events),
    b AS (SELECT *, CAST(floor((frame_seconds - 86400) * 0.0005) AS BIGINT) AS sample_index FROM f
      WHERE frame_seconds >= 86400 AND frame_seconds < 86400 + 1728000)
    SELECT source_id, sample_index, CAST(first.frame_index AS BIGINT) AS frame_index, round(first.value, 6) AS value FROM (
      SELECT source_id, sample_index, arg_min({'frame_index': frame_index, 'value': value}, (frame_seconds, frame_index)) AS first
      FROM b GROUP BY 1, 2)""",
)
def sampled_frames(spark, sf):
    frames = stand_in(
        spark,
        sf,
        "events",
        "user_id AS source_id, event_id AS frame_index, "
        "(unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 1000000D AS frame_seconds, value",
    )
    return result(
        segments.sample_frames(frames, fps=0.0005, start=86400, duration=1728000),
        "source_id",
        "sample_index:i",
        "frame_index:i",
        "value:d",
    )


@query(
    "resampled_timeline",
    """WITH e AS (SELECT label AS source_id, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings),
    n AS (SELECT source_id, count(*) AS n FROM e GROUP BY 1),
    o AS (SELECT source_id, n, unnest(range(0, greatest(n, CAST(round_even(n * 60.0::DOUBLE / 24.0::DOUBLE, 0) AS BIGINT)))) AS j FROM n),
    p AS (SELECT *, CAST(floor(j * 24.0::DOUBLE / 60.0::DOUBLE) AS BIGINT) AS l, j * 24.0::DOUBLE / 60.0::DOUBLE AS pos FROM o),
    w AS (SELECT *, least(n - 1, l + 1) AS r, CASE WHEN l + 1 < n THEN pos - l ELSE 0.0 END AS weight FROM p)
    SELECT w.source_id, CAST(j AS BIGINT) AS output_index, CAST(l AS BIGINT) AS left_index, CAST(r AS BIGINT) AS right_index,
      round(weight, 6) AS weight,
      round(a.embedding[1]::DOUBLE + (b.embedding[1]::DOUBLE - a.embedding[1]::DOUBLE) * weight, 6) AS first_pixel,
      round(a.embedding[64]::DOUBLE + (b.embedding[64]::DOUBLE - a.embedding[64]::DOUBLE) * weight, 6) AS last_pixel
    FROM w JOIN e a ON a.source_id = w.source_id AND a.i = w.l JOIN e b ON b.source_id = w.source_id AND b.i = w.r""",
)
def resampled_timeline(spark, sf):
    from framelane.bindings.frames import clip_frames

    out = segments.resample_timeline(clip_frames(spark, sf), 24.0, 60.0, keys=("source_id",), values="pixels")
    return result(
        out.withColumns({"first_pixel": F.element_at("pixels", 1), "last_pixel": F.element_at("pixels", 64)}),
        "source_id",
        "output_index:i",
        "left_index:i",
        "right_index:i",
        "weight:d",
        "first_pixel:d",
        "last_pixel:d",
    )


# --- the planners as SQL table functions ----------------------------------------------------------------------------------------------


def _call(spark, rows, function: str, options: str):
    table_functions.register(spark)
    return spark.sql(f"SELECT * FROM {function}(TABLE({{rows}}){options})", rows=spread(rows))


@query("sql_segment_plan", ORACLES["segment_plan"])
def sql_segment_plan(spark, sf):
    clips = _clips(spark, sf).select("source_id", F.col("frame_count").alias("n_frames"), "frame_rate")
    rows = _call(spark, clips, "plan_segments", ", frames => 'n_frames', seconds => 10")
    return result(rows, "source_id", "segment_index:i", "start_frame:i", "frame_count:i", "start_seconds:d", "duration_seconds:d")


@query("sql_temporal_chunks", ORACLES["temporal_chunks"])
def sql_temporal_chunks(spark, sf):
    rows = _call(spark, _clips(spark, sf).select("source_id", "frame_count"), "plan_temporal_chunks", " PARTITION BY source_id, chunk => 32")
    return result(rows, "source_id", "chunk_index:i", *[f"{c}:i" for c in CHUNK_COLUMNS])


@query("sql_tile_plan", ORACLES["tile_plan_average"])
def sql_tile_plan(spark, sf):
    options = ", tile => 200, overlap => 24, mode => 'average', multiple => 8"
    return _tile_result(_call(spark, stand_in(spark, sf, "part", TILE_SRC), "plan_tiles", options))
