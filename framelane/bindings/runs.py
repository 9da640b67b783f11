"""Run and telemetry queries: orders and their lines as benchmark runs, events as progress and GPU samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelane.bindings.registry import query, result, stand_in, table
from framelane.functions.numeric import STAGES
from framelane.operators import avsync, runs, sampled_rate, telemetry
from framelane.operators.ordered import time_block

STAGE_EVENTS = """l_orderkey AS run_id, l_quantity - 5 AS seconds,
CASE l_linenumber WHEN 1 THEN 'extract' WHEN 2 THEN 'denoise' WHEN 3 THEN 'colorize' WHEN 4 THEN 'upscale'
  WHEN 5 THEN 'interpolate' WHEN 6 THEN 'encode' ELSE 'remux' END AS stage"""
RUNS = """
o_orderkey AS run_id, o_orderpriority AS execution_path, CAST(substr(o_orderpriority, 1, 1) AS INT) AS path_ordinal,
CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS status, o_totalprice / 64 AS wall_seconds,
CASE WHEN o_custkey % 9 > 0 THEN o_totalprice / 32 END AS average_throughput_fps,
CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 1024 END AS process_rss_bytes,
CASE WHEN o_orderkey % 5 > 0 THEN o_custkey * 4096 END AS gpu_memory_used_bytes,
o_custkey * 8192 AS scratch_size_bytes, o_orderkey % 101 AS max_gpu_utilization_percent,
CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 40 END AS diagnostic_source_frames,
CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 30 END AS media_source_frames,
CASE WHEN o_orderkey % 5 > 1 THEN o_custkey % 50 END AS frame_count,
CASE WHEN o_orderkey % 6 > 1 THEN o_custkey % 20 END AS diagnostic_output_frames, 24 AS fallback_frames
"""
STAGE_SQL = f"""se AS (SELECT {STAGE_EVENTS} FROM lineitem),
  st AS (SELECT run_id, {", ".join(f"coalesce(sum(seconds) FILTER (WHERE stage = '{s}' AND seconds > 0), 0.0) AS {s}_seconds" for s in STAGES)}
    FROM se GROUP BY run_id)"""


def _frames_sql(stage: str) -> str:
    names = ("diagnostic_source_frames", "media_source_frames")
    if stage not in runs.SOURCE_STAGES:
        names = ("frame_count", "diagnostic_output_frames")
    return "coalesce(" + ", ".join(f"CASE WHEN {n} > 0 THEN {n} END" for n in names) + ", fallback_frames)"


RUN_SQL = f"""{STAGE_SQL}, ru AS (SELECT * FROM (SELECT {RUNS} FROM orders) JOIN st USING (run_id)),
  sm AS ({" UNION ALL ".join(f"SELECT run_id, '{s}' AS stage, {s}_seconds AS seconds, {_frames_sql(s)} AS frames FROM ru WHERE {s}_seconds > 0" for s in STAGES)})"""


def stage_table(spark, sf):
    return runs.stage_seconds(stand_in(spark, sf, "lineitem", STAGE_EVENTS), ["run_id"])


def run_table(spark, sf):
    return stand_in(spark, sf, "orders", RUNS).join(stage_table(spark, sf), "run_id")


@query(
    "stage_seconds",
    f"WITH {STAGE_SQL} SELECT run_id, " + ", ".join(f"round({s}_seconds, 6) AS {s}_seconds" for s in STAGES) + " FROM st",
)
def stage_seconds(spark, sf):
    return result(stage_table(spark, sf), "run_id", *[f"{s}_seconds:d" for s in STAGES])


@query("stage_frame_counts", f"WITH {RUN_SQL} SELECT run_id, stage, CAST(frames AS BIGINT) AS frames FROM sm")
def stage_frame_counts(spark, sf):
    return result(runs.stage_frame_counts(run_table(spark, sf)), "run_id", "stage", "frames:i")


@query("stage_effective_fps", f"WITH {RUN_SQL} SELECT run_id, stage, round(frames / seconds, 6) AS fps FROM sm")
def stage_effective_fps(spark, sf):
    return result(runs.stage_effective_fps(run_table(spark, sf)), "run_id", "stage", "fps:d")


LONG_SQL = f"""{RUN_SQL}, co AS (SELECT * FROM ru WHERE status = 'completed'),
  lo AS ({" UNION ALL ".join(f"SELECT run_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM co" for m in runs.RUN_METRICS)}
    UNION ALL SELECT run_id, stage || '_fps', round(frames / seconds, 6) FROM sm WHERE run_id IN (SELECT run_id FROM co)
    UNION ALL SELECT run_id, stage || '_frames', frames FROM sm WHERE run_id IN (SELECT run_id FROM co)),
  su AS (SELECT execution_path, metric, count(*) AS runs,
      CASE WHEN metric LIKE '%!_frames' ESCAPE '!' THEN floor(median(value)) ELSE round(median(value), 6) END AS median, round(avg(value), 6) AS average
    FROM lo JOIN co USING (run_id) WHERE value IS NOT NULL GROUP BY 1, 2)"""


@query(
    "run_summary",
    f"""WITH {LONG_SQL} SELECT execution_path, metric, CAST(runs AS BIGINT) AS runs, CAST(median AS DOUBLE) AS median,
    round(average, 4) AS average FROM su""",
)
def run_summary(spark, sf):
    return result(
        runs.summarize_runs(run_table(spark, sf)), "execution_path", "metric", "runs:i", "median:d", "average:d4"
    )


@query(
    "selected_path",
    f"""WITH {RUN_SQL}, c AS (SELECT * FROM ru WHERE status = 'completed')
    SELECT run_id, execution_path, round(wall_seconds, 9) AS wall_seconds FROM c
    WHERE path_ordinal = (SELECT min(path_ordinal) FROM c)""",
)
def selected_path(spark, sf):
    return result(runs.select_execution_path(run_table(spark, sf)), "run_id", "execution_path", "wall_seconds:d9")


LOWER = ", ".join(f"'{m}'" for m in runs.LOWER_IS_BETTER)


@query(
    "run_comparison",
    f"""WITH {LONG_SQL}, j AS (SELECT coalesce(a.metric, b.metric) AS metric, a.median AS before, b.median AS after
      FROM (SELECT * FROM su WHERE execution_path = '1-URGENT') a FULL JOIN
      (SELECT * FROM su WHERE execution_path = '5-LOW') b ON a.metric = b.metric),
    p AS (SELECT *, after - before AS d, CASE WHEN before <> 0 THEN (after - before) / before * 100.0 END AS pc FROM j)
    SELECT metric, CAST(before AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after, round(d, 6) AS delta, round(pc, 4) AS percent_change,
      round(CASE WHEN metric IN ({LOWER}) THEN -pc ELSE pc END, 4) AS improvement_percent FROM p""",
)
def run_comparison(spark, sf):
    summary = runs.summarize_runs(run_table(spark, sf))
    before = summary.where("execution_path = '1-URGENT'")
    after = summary.where("execution_path = '5-LOW'")
    return runs.compare_runs(before, after)


REPEATS = """
l_suppkey AS model_id, CAST(l_linenumber * 64 AS INT) AS tile_size, CASE WHEN l_suppkey % 10 = 0 THEN 0.0 ELSE l_quantity / 4 END AS wall_seconds,
l_quantity / 8 AS inference_seconds, l_quantity / 16 AS batch_load_seconds, l_quantity / 32 AS save_seconds,
l_suppkey % 90 AS frame_count, 640 + l_suppkey AS width, 360 + l_linenumber AS height
"""


@query(
    "repeat_summary",
    f"""WITH r AS (SELECT {REPEATS} FROM lineitem), g AS (SELECT model_id, tile_size, count(*) AS n, min(wall_seconds) AS best,
      avg(wall_seconds) AS w, avg(inference_seconds) AS i, avg(batch_load_seconds) AS b, avg(save_seconds) AS s,
      max(frame_count) AS f, max(width) AS wd, max(height) AS ht FROM r GROUP BY 1, 2)
    SELECT model_id, CAST(tile_size AS BIGINT) AS tile_size, CAST(n AS BIGINT) AS repeats, round(best::DOUBLE, 4) AS best_wall_seconds,
      round(w, 4) AS average_wall_seconds, round(i, 4) AS average_inference_seconds, round(b, 4) AS average_batch_load_seconds,
      round(s, 4) AS average_save_seconds, round(CASE WHEN best > 0 THEN f / best::DOUBLE ELSE 0.0 END, 3) AS best_images_per_second,
      round(CASE WHEN best > 0 THEN f::DOUBLE * wd * ht / 1000000 / best::DOUBLE ELSE 0.0 END, 3) AS best_megapixels_per_second FROM g""",
)
def repeat_summary(spark, sf):
    return result(
        runs.summarize_repeats(stand_in(spark, sf, "lineitem", REPEATS)),
        "model_id",
        "tile_size:i",
        "repeats:i",
        *[f"average_{c}_seconds:d" for c in ("wall", "inference", "batch_load", "save")],
        "best_wall_seconds:d",
        "best_images_per_second:d",
        "best_megapixels_per_second:d",
    )


OVERHEAD = """
CASE event_type WHEN 'view' THEN 'launchBaseline' WHEN 'click' THEN 'decodeToNull' WHEN 'signup' THEN 'extractToPng'
  WHEN 'error' THEN 'encodeFromPng' ELSE 'remuxAudio' END AS name, value AS seconds
"""
OVERHEAD_SQL = f"""o AS (SELECT {OVERHEAD} FROM events), s AS (SELECT name, count(*) AS n, round(min(seconds), 6) AS lo,
  round(max(seconds), 6) AS hi, round(avg(seconds), 6) AS av, round(median(seconds), 6) AS md FROM o GROUP BY 1)"""


@query(
    "overhead_summary",
    f"""WITH {OVERHEAD_SQL} SELECT name, CAST(n AS BIGINT) AS samples, lo AS min_seconds, hi AS max_seconds,
    av AS average_seconds, md AS median_seconds FROM s""",
)
def overhead_summary(spark, sf):
    return result(
        runs.overhead_summary(stand_in(spark, sf, "events", OVERHEAD)),
        "name",
        "samples:i",
        *[f"{c}_seconds:d" for c in ("min", "max", "average", "median")],
    )


@query(
    "launch_overhead",
    f"""WITH {OVERHEAD_SQL}, l AS (SELECT md AS launch FROM s WHERE name = 'launchBaseline')
    SELECT name, round(CASE WHEN md > 0 THEN launch / md * 100.0 ELSE 0.0 END, 2) AS launch_share_percent,
      round(greatest(0.0, md - launch), 6) AS seconds_minus_launch FROM s, l WHERE name <> 'launchBaseline'""",
)
def launch_overhead(spark, sf):
    summary = runs.overhead_summary(stand_in(spark, sf, "events", OVERHEAD))
    return runs.launch_overhead(summary, "launchBaseline")


@query(
    "overhead_differences",
    f"""WITH {OVERHEAD_SQL}, m AS (SELECT map(list(name), list(md)) AS m FROM s)
    SELECT round(greatest(0.0, m['extractToPng'] - m['decodeToNull']), 6) AS png_over_decode_seconds,
      round(m['encodeFromPng'] - m['remuxAudio'] - 2 * m['decodeToNull'], 6) AS encode_minus_remux_and_decodes_seconds FROM m""",
)
def overhead_differences(spark, sf):
    return runs.overhead_differences(
        runs.overhead_summary(stand_in(spark, sf, "events", OVERHEAD)),
        {
            "png_over_decode_seconds": [("extractToPng", 1), ("decodeToNull", -1)],
            "encode_minus_remux_and_decodes_seconds": [("encodeFromPng", 1), ("remuxAudio", -1), ("decodeToNull", -2)],
        },
        floored=("png_over_decode_seconds",),
    )


THROUGHPUT = """
o_orderkey AS run_id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 11 END AS remuxed_frames, o_custkey % 7 AS encoded_frames,
o_custkey % 5 AS total_frames, CAST(o_orderkey % 13 AS DOUBLE) / 8 AS elapsed_seconds
"""


@query(
    "run_throughput",
    f"""WITH r AS (SELECT {THROUGHPUT} FROM orders), f AS (SELECT *, greatest(1, coalesce(nullif(remuxed_frames, 0),
      nullif(encoded_frames, 0), total_frames)) AS n FROM r)
    SELECT run_id, CAST(n AS BIGINT) AS resolved_frames, round(n / greatest(0.001::DOUBLE, elapsed_seconds), 6) AS throughput_fps FROM f""",
)
def run_throughput(spark, sf):
    return result(
        runs.run_throughput(stand_in(spark, sf, "orders", THROUGHPUT)), "run_id", "resolved_frames:i", "throughput_fps:d"
    )


DENOISERS = """
s_suppkey AS run_order, s_name AS model_id, s_nationkey * 3 AS frames, CAST(s_nationkey % 6 AS DOUBLE) / 2 AS seconds,
CASE WHEN s_acctbal < 4000 THEN 'checkpoint missing' END AS error
"""


@query(
    "denoiser_runs",
    f"""WITH d AS (SELECT {DENOISERS} FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY error IS NULL ORDER BY run_order) AS rn FROM d)
    SELECT model_id, CASE WHEN error IS NULL THEN 'succeeded' ELSE 'skipped' END AS status,
      round(CASE WHEN error IS NULL AND seconds > 0 THEN frames / seconds END, 6) AS frames_per_second,
      CAST(CASE WHEN error IS NULL AND rn <= 3 THEN rn END AS BIGINT) AS slot FROM r""",
)
def denoiser_runs(spark, sf):
    results, layout = runs.denoiser_runs(stand_in(spark, sf, "supplier", DENOISERS))
    joined = results.join(F.broadcast(layout), "model_id", "left")  # the layout has three rows
    return result(joined, "model_id", "status", "frames_per_second:d", "slot:i")


# --- telemetry ------------------------------------------------------------------------------------------------------

LINES = """
user_id AS run_id, CAST(floor(event_id / 300) AS BIGINT) AS sample_seq,
CASE event_id % 11 WHEN 0 THEN 'n/a, 10, 20' WHEN 1 THEN '7' WHEN 2 THEN '12, bad, 1000' WHEN 3 THEN '' WHEN 4 THEN '55, 300, none'
  ELSE ' ' || CAST(event_id % 101 AS STRING) || ', ' || CAST(event_id * 37 % 20000 AS STRING) || '.5 , ' || CAST(24000 + user_id AS STRING) END AS line
"""
SAMPLE_SQL = f"""li AS (SELECT {LINES} FROM events), pa AS (SELECT *, string_split(trim(line), ',') AS p FROM li),
  u AS (SELECT run_id, sample_seq, p, CASE WHEN len(p) >= 3 THEN trunc(TRY_CAST(trim(p[1]) AS DOUBLE)) END AS ut FROM pa),
  m AS (SELECT *, CASE WHEN ut IS NOT NULL THEN trunc(TRY_CAST(trim(p[2]) AS DOUBLE)) END AS us FROM u),
  t AS (SELECT *, CASE WHEN us IS NOT NULL THEN trunc(TRY_CAST(trim(p[3]) AS DOUBLE)) END AS tt FROM m),
  sa AS (SELECT run_id, sample_seq, max(ut) AS ut, sum(us) AS us, sum(tt) AS tt FROM t GROUP BY 1, 2),
  gs AS (SELECT run_id, sample_seq, CAST(CASE WHEN ut IS NOT NULL AND tt IS NOT NULL THEN ut END AS BIGINT) AS utilization_percent,
    CAST(CASE WHEN ut IS NOT NULL AND tt IS NOT NULL THEN us * 1048576 END AS BIGINT) AS memory_used_bytes,
    CAST(CASE WHEN ut IS NOT NULL AND tt IS NOT NULL THEN tt * 1048576 END AS BIGINT) AS memory_total_bytes FROM sa)"""


def gpu_samples(spark, sf):
    return telemetry.parse_gpu_samples(stand_in(spark, sf, "events", LINES))


@query("gpu_samples", f"WITH {SAMPLE_SQL} SELECT * FROM gs")
def gpu_samples_query(spark, sf):
    return gpu_samples(spark, sf)


@query(
    "gpu_activity",
    f"""WITH {SAMPLE_SQL}, g AS (SELECT run_id, count(utilization_percent) AS n, count(*) FILTER (WHERE utilization_percent >= 5) AS a,
      max(utilization_percent) AS mu, arg_min(memory_used_bytes, sample_seq) FILTER (WHERE utilization_percent IS NOT NULL AND memory_used_bytes IS NOT NULL) AS f,
      max(memory_used_bytes) FILTER (WHERE utilization_percent IS NOT NULL) AS pk FROM gs GROUP BY 1),
    d AS (SELECT *, greatest(0, pk - f) AS delta FROM g),
    v AS (SELECT *, coalesce(mu >= 5, FALSE) OR coalesce(delta >= 268435456, FALSE) AS detected FROM d)
    SELECT run_id, CAST(n AS BIGINT) AS sample_count, CAST(a AS BIGINT) AS active_sample_count, CAST(mu AS BIGINT) AS max_utilization_percent,
      CAST(f AS BIGINT) AS first_memory_bytes, CAST(pk AS BIGINT) AS peak_memory_bytes, CAST(delta AS BIGINT) AS memory_delta_bytes,
      detected AS activity_detected, n > 0 AND NOT detected AS warned FROM v""",
)
def gpu_activity(spark, sf):
    out = telemetry.assess_gpu_activity(gpu_samples(spark, sf)).withColumn("warned", F.col("warning").isNotNull())
    return result(
        out,
        "run_id",
        *[f"{c}:i" for c in ("sample_count", "active_sample_count", "max_utilization_percent")],
        *[f"{c}:i" for c in ("first_memory_bytes", "peak_memory_bytes", "memory_delta_bytes")],
        "activity_detected",
        "warned",
    )


DEVICES = """user_id AS run_id, CAST(floor(event_id / 500) AS BIGINT) AS sample_seq, event_id % 4000 AS memory_used_mib,
CASE WHEN user_id % 5 = 0 THEN 0 ELSE 8192 END AS memory_total_mib"""


@query(
    "gpu_memory_totals",
    f"""WITH d AS (SELECT {DEVICES} FROM events), s AS (SELECT run_id, sample_seq, sum(memory_used_mib) AS u, sum(memory_total_mib) AS t FROM d GROUP BY 1, 2)
    SELECT run_id, sample_seq, CAST(CASE WHEN t > 0 THEN u * 1048576 END AS BIGINT) AS gpu_memory_used_bytes,
      CAST(CASE WHEN t > 0 THEN t * 1048576 END AS BIGINT) AS gpu_memory_total_bytes FROM s""",
)
def gpu_memory_totals(spark, sf):
    return telemetry.gpu_memory_totals(stand_in(spark, sf, "events", DEVICES))


PROGRESS = """
user_id AS job_id, event_id, ts, event_type AS phase, CAST(floor(value / 40) AS BIGINT) AS percent,
CAST(floor(value * 8) AS BIGINT) AS processed_frames, CAST(1200 AS BIGINT) AS total_frames, event_type AS message,
CASE WHEN event_id % 3 > 0 THEN event_id * 512 END AS process_rss_bytes,
CASE WHEN event_id % 4 > 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS gpu_memory_used_bytes,
CASE WHEN event_id % 4 > 0 THEN event_id * 100 END AS gpu_memory_total_bytes,
event_id * 3 AS scratch_size_bytes, CAST(floor(value) AS BIGINT) AS output_size_bytes
"""
PROGRESS_SQL = f"pr AS (SELECT {PROGRESS}, epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events)"
ORDER = ["ts", "event_id"]
DAY = 86_400


def progress(spark, sf):
    return stand_in(spark, sf, "events", PROGRESS)


@query(
    "resource_peaks",
    f"""WITH {PROGRESS_SQL} SELECT job_id, CAST(max(process_rss_bytes) AS BIGINT) AS process_rss_bytes,
    CAST(max(gpu_memory_used_bytes) AS BIGINT) AS gpu_memory_used_bytes,
    CAST(max_by({{'v': gpu_memory_total_bytes}}, (ts, event_id)).v AS BIGINT) AS gpu_memory_total_bytes,
    CAST(max(scratch_size_bytes) AS BIGINT) AS scratch_size_bytes, CAST(max(output_size_bytes) AS BIGINT) AS output_size_bytes FROM pr GROUP BY 1""",
)
def resource_peaks(spark, sf):
    return telemetry.resource_peaks(progress(spark, sf), order=ORDER)


@query(
    "progress_throughput",
    f"""WITH {PROGRESS_SQL}, l AS (SELECT *, s - min(s) OVER (PARTITION BY job_id) AS el,
      lag(s) OVER w AS ps, lag(processed_frames) OVER w AS pf FROM pr WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
    a AS (SELECT *, CASE WHEN el > 0 AND processed_frames > 0 THEN processed_frames / el END AS av FROM l)
    SELECT job_id, event_id, round(el, 3) AS elapsed_seconds, round(av, 6) AS average_fps,
      round(CASE WHEN s - ps >= 1 THEN greatest(0, processed_frames - pf) / (s - ps) END, 6) AS rolling_fps,
      round(CASE WHEN total_frames > processed_frames THEN (total_frames - processed_frames) / av END, 3) AS remaining_seconds FROM a""",
)
def progress_throughput(spark, sf):
    return result(
        telemetry.throughput(progress(spark, sf), order=ORDER, block_seconds=DAY),
        "job_id",
        "event_id",
        "elapsed_seconds:d3",
        "average_fps:d",
        "rolling_fps:d",
        "remaining_seconds:d3",
    )


@query(
    "sampled_throughput",
    f"""WITH RECURSIVE {PROGRESS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n FROM pr),
    k AS (SELECT job_id, n, s AS t, processed_frames AS f, NULL::DOUBLE AS rate FROM o WHERE n = 1
      UNION ALL SELECT k.job_id, o.n, CASE WHEN o.s - k.t >= 14400 THEN o.s ELSE k.t END, CASE WHEN o.s - k.t >= 14400 THEN o.processed_frames ELSE k.f END,
        CASE WHEN o.s - k.t >= 14400 THEN greatest(0, o.processed_frames - k.f) / (o.s - k.t) ELSE k.rate END FROM k JOIN o ON o.job_id = k.job_id AND o.n = k.n + 1),
    a AS (SELECT o.*, rate, s - min(s) OVER (PARTITION BY job_id) AS el FROM o JOIN k USING (job_id, n))
    SELECT job_id, event_id, round(el, 3) AS elapsed_seconds, round(CASE WHEN el > 0 AND processed_frames > 0 THEN processed_frames / el END, 6) AS average_fps,
      round(rate, 9) AS rolling_fps FROM a""",
)
def sampled_throughput(spark, sf):
    out = sampled_rate.sampled_throughput(progress(spark, sf), order=ORDER, min_gap=14_400, block_seconds=DAY)
    return result(out, "job_id", "event_id", "elapsed_seconds:d3", "average_fps:d", "rolling_fps:d9")


@query(
    "deduped_progress",
    f"""WITH {PROGRESS_SQL}, l AS (SELECT *, lag((phase, percent, message)) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS b FROM pr)
    SELECT job_id, event_id, phase, percent FROM l WHERE b IS DISTINCT FROM (phase, percent, message)""",
)
def deduped_progress(spark, sf):
    return telemetry.dedupe_progress(
        progress(spark, sf), order=ORDER, signature=("phase", "percent", "message"), block_seconds=DAY
    ).select("job_id", "event_id", "phase", "percent")


GATE = """event_id, CASE WHEN event_type = 'view' THEN 'extracting' ELSE event_type END AS phase, event_id % 3 AS upscaled_frames,
user_id % 2 AS interpolated_frames, CASE WHEN event_id % 5 > 0 THEN 0 END AS encoded_frames, 0 AS remuxed_frames"""


@query(
    "gated_progress",
    f"""WITH g AS (SELECT {GATE} FROM events) SELECT event_id, phase FROM g
    WHERE phase <> 'extracting' OR NOT (upscaled_frames > 0 OR interpolated_frames > 0 OR coalesce(encoded_frames, 0) > 0)""",
)
def gated_progress(spark, sf):
    return telemetry.gate_extracting(stand_in(spark, sf, "events", GATE)).select("event_id", "phase")


COUNTERS = """
o_orderkey AS job_id, 1 + o_custkey % 700 AS total_frames, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 300 END AS source_total_frames,
o_orderkey % 500 AS extracted_frames, o_custkey % 450 AS denoised_frames, o_orderkey % 350 AS colorized_frames,
o_custkey % 600 AS upscaled_frames, o_orderkey % 800 AS interpolated_frames, CASE WHEN o_orderkey % 6 > 0 THEN o_custkey % 400 END AS encoded_frames,
o_orderkey % 200 AS remuxed_frames,
CASE o_orderkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'afterUpscale' ELSE 'interpolateOnly' END AS interpolation_mode,
CASE WHEN o_custkey % 2 = 0 THEN 'off' ELSE 'hqdn3d' END AS denoise_mode,
CASE o_custkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'beforeUpscale' ELSE 'colorizeOnly' END AS colorization_mode
"""


def _scaled_sql(c: str) -> str:
    return (
        f"CASE WHEN interpolation_mode = 'off' THEN {c} WHEN st > 0 THEN least(total_frames, greatest(0, "
        f"CAST(round_even({c}::DOUBLE / st * total_frames, 0) AS BIGINT))) ELSE 0 END"
    )


RATIO = "greatest(0.0, least(1.0, {c}::DOUBLE / total_frames))"


@query(
    "progress_percent",
    f"""WITH c AS (SELECT {COUNTERS} FROM orders), s AS (SELECT *, CASE WHEN source_total_frames > 0 THEN source_total_frames ELSE total_frames END AS st,
      CASE WHEN denoise_mode <> 'off' THEN 10 ELSE 0 END AS dw, interpolation_mode = 'interpolateOnly' AS im, colorization_mode = 'colorizeOnly' AS cm,
      interpolation_mode = 'afterUpscale' AS au, colorization_mode = 'beforeUpscale' AS bu, coalesce(encoded_frames, 0) AS en FROM c),
    e AS (SELECT *, {_scaled_sql('extracted_frames')} AS xe, {_scaled_sql('denoised_frames')} AS xd, {_scaled_sql('colorized_frames')} AS xc,
      {_scaled_sql('upscaled_frames')} AS xu FROM s),
    w AS (SELECT *, CASE WHEN im THEN 0 WHEN cm THEN 70 - dw WHEN au THEN CASE WHEN bu THEN 15 ELSE 0 END ELSE CASE WHEN bu THEN 20 ELSE 0 END END AS wc,
      CASE WHEN im OR cm THEN 0 WHEN au THEN CASE WHEN bu THEN 20 ELSE 35 END - dw ELSE CASE WHEN bu THEN 50 ELSE 70 END - dw END AS wu,
      CASE WHEN im THEN 70 - dw WHEN cm THEN 0 WHEN au THEN 35 ELSE 0 END AS wi FROM e)
    SELECT job_id, CAST(least(99, CAST(round_even({RATIO.format(c='xe')} * 10 + {RATIO.format(c='xd')} * dw + {RATIO.format(c='xc')} * wc
      + {RATIO.format(c='xu')} * wu + {RATIO.format(c='interpolated_frames')} * wi + {RATIO.format(c='en')} * 15 + {RATIO.format(c='remuxed_frames')} * 5, 0) AS BIGINT)) AS BIGINT) AS percent,
      CAST(greatest(xe, xd, xc, xu, interpolated_frames, en, remuxed_frames) AS BIGINT) AS processed_frames FROM w""",
)
def progress_percent(spark, sf):
    return result(
        telemetry.progress_percent(stand_in(spark, sf, "orders", COUNTERS)), "job_id", "percent:i", "processed_frames:i"
    )


@query(
    "tumbling_rollup",
    f"""WITH {PROGRESS_SQL} SELECT job_id, CAST(floor(s / 21600) * 21600 AS BIGINT) AS window_start, CAST(floor(s / 21600) * 21600 + 21600 AS BIGINT) AS window_end,
    CAST(count(*) AS BIGINT) AS samples, round(avg(processed_frames), 6) AS average_fps, CAST(max(gpu_memory_used_bytes) AS BIGINT) AS peak_memory FROM pr GROUP BY ALL""",
)
def tumbling_rollup(spark, sf):
    out = telemetry.window_rollup(progress(spark, sf), size="6 hours", fps="processed_frames")
    return result(out, "job_id", "window_start:i", "window_end:i", "samples:i", "average_fps:d", "peak_memory:i")


@query(
    "sliding_rollup",
    f"""WITH {PROGRESS_SQL}, w AS (SELECT *, unnest([CAST(floor(s / 10800) AS BIGINT) * 10800, CAST(floor(s / 10800) AS BIGINT) * 10800 - 10800]) AS ws FROM pr)
    SELECT job_id, ws AS window_start, ws + 21600 AS window_end, CAST(count(*) AS BIGINT) AS samples, round(avg(processed_frames), 6) AS average_fps,
    CAST(max(gpu_memory_used_bytes) AS BIGINT) AS peak_memory FROM w GROUP BY ALL""",
)
def sliding_rollup(spark, sf):
    out = telemetry.window_rollup(progress(spark, sf), size="6 hours", slide="3 hours", fps="processed_frames")
    return result(out, "job_id", "window_start:i", "window_end:i", "samples:i", "average_fps:d", "peak_memory:i")


@query(
    "session_rollup",
    f"""WITH {PROGRESS_SQL}, g AS (SELECT *, CASE WHEN s - lag(s) OVER w < 14400 THEN 0 ELSE 1 END AS o FROM pr WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(o) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT job_id, CAST(k AS BIGINT) AS session_index, round(min(s), 3) AS start_seconds, round(max(s), 3) AS end_seconds, CAST(count(*) AS BIGINT) AS samples,
      round(avg(processed_frames), 6) AS average_fps FROM i GROUP BY 1, 2""",
)
def session_rollup(spark, sf):
    out = telemetry.session_rollup(progress(spark, sf), 14_400, order=ORDER, fps="processed_frames", block_seconds=DAY)
    return result(out, "job_id", "session_index:i", "start_seconds:d3", "end_seconds:d3", "samples:i", "average_fps:d")


# --- A/V synchronisation --------------------------------------------------------------------------------------------


@query(
    "rising_edges",
    """WITH l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT user_id AS media_id, event_id, round(value, 6) AS value FROM l WHERE value >= 30 AND coalesce(p < 30, TRUE)""",
)
def rising_edges(spark, sf):
    signal = table(spark, sf, "events").select(F.col("user_id").alias("media_id"), "event_id", "ts", "value")
    out = telemetry.rising_edges(signal, 30.0, order=ORDER, value="value", block=time_block("ts", DAY))
    return result(out, "media_id", "event_id", "value:d")


AUDIO = """o_orderkey % 3 AS media_id, CAST(floor(o_orderkey / 3) AS BIGINT) AS sample_index,
CAST(CAST(floor(o_totalprice) AS BIGINT) % 65536 - 32768 AS SMALLINT) AS sample"""


@query(
    "audio_levels",
    f"""WITH a AS (SELECT {AUDIO} FROM orders) SELECT media_id, CAST(sample_index // 220 AS BIGINT) AS window_index,
    round(sample_index // 220 * 220 / 44100.0::DOUBLE, 6) AS window_seconds, CAST(max(abs(sample::INT)) AS BIGINT) AS level FROM a
    GROUP BY media_id, sample_index // 220 HAVING count(*) = 220""",
)
def audio_levels(spark, sf):
    out = avsync.audio_levels(stand_in(spark, sf, "orders", AUDIO), 44_100)
    return result(out, "media_id", "window_index:i", "window_seconds:d", "level:i")


AV_SQL = """av AS (SELECT user_id AS media_id, CASE event_type WHEN 'view' THEN 'expected' WHEN 'click' THEN 'video' WHEN 'purchase' THEN 'audio' END AS stream,
    epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 AS seconds, event_id FROM events),
  nu AS (SELECT *, row_number() OVER (PARTITION BY media_id, stream ORDER BY seconds, event_id) - 1 AS k FROM av WHERE stream IS NOT NULL),
  al AS (SELECT e.media_id, e.k, e.seconds AS es, v.seconds AS vs, a.seconds AS au FROM nu e
    JOIN nu v ON v.media_id = e.media_id AND v.k = e.k AND v.stream = 'video' JOIN nu a ON a.media_id = e.media_id AND a.k = e.k AND a.stream = 'audio'
    WHERE e.stream = 'expected')"""


def _av_events(spark, sf):
    stream = "CASE event_type WHEN 'view' THEN 'expected' WHEN 'click' THEN 'video' WHEN 'purchase' THEN 'audio' END"
    return stand_in(
        spark,
        sf,
        "events",
        f"user_id AS media_id, {stream} AS stream, unix_micros(CAST(ts AS TIMESTAMP)) / 1000000D - 1704067200D AS seconds, event_id",
    ).where("stream IS NOT NULL")


@query(
    "aligned_events",
    f"""WITH {AV_SQL} SELECT media_id, CAST(k AS BIGINT) AS event_index, round((vs - es) * 1000.0::DOUBLE, 3) AS video_offset_ms,
    round((au - es) * 1000.0::DOUBLE, 3) AS audio_offset_ms, round((au - vs) * 1000.0::DOUBLE, 3) AS av_offset_ms FROM al""",
)
def aligned_events(spark, sf):
    out = avsync.align_events(_av_events(spark, sf), order=("seconds", "event_id"))
    return result(out, "media_id", "event_index:i", "video_offset_ms:d3", "audio_offset_ms:d3", "av_offset_ms:d3")


@query(
    "av_sync_report",
    f"""WITH {AV_SQL} SELECT media_id, CAST(count(*) AS BIGINT) AS compared_events, round(max(abs((vs - es) * 1000.0::DOUBLE)), 3) AS max_video_offset_ms,
    round(max(abs((au - es) * 1000.0::DOUBLE)), 3) AS max_audio_offset_ms, round(max(abs((au - vs) * 1000.0::DOUBLE)), 3) AS max_av_offset_ms,
    max(abs((au - vs) * 1000.0::DOUBLE)) <= 400000000 AS passed FROM al GROUP BY 1""",
)
def av_sync_report(spark, sf):
    out = avsync.av_sync_report(
        avsync.align_events(_av_events(spark, sf), order=("seconds", "event_id")), tolerance_ms=400_000_000
    )
    return result(
        out, "media_id", "compared_events:i", "max_video_offset_ms:d3", "max_audio_offset_ms:d3", "max_av_offset_ms:d3", "passed"
    )
