"""Job, request, catalog and library queries over orders, customers, suppliers, documents and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framelane.bindings.registry import query, result, split_columns, stand_in, table
from framelane.operators import catalog, completeness, jobs, library, requests
from framelane.session import ensure_checkpoint_dir
from framelane.sources import media, segments, versions

JOBS = """
o_orderkey AS job_id, CASE WHEN o_custkey % 9 = 0 THEN 'sourceConversion' ELSE 'pipeline' END AS job_kind,
'Job ' || o_orderpriority AS label,
CASE o_custkey % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' WHEN 3 THEN 'succeeded' WHEN 4 THEN 'failed'
  WHEN 5 THEN 'cancelled' WHEN 6 THEN 'interrupted' END AS state,
CASE o_orderkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'extracting' WHEN 3 THEN 'upscaling' ELSE 'encoding' END AS phase,
CAST(o_orderkey % 103 AS INT) AS percent,
CASE o_orderkey % 7 WHEN 0 THEN 'Cancelled by user' WHEN 1 THEN 'Worker FAILED' WHEN 2 THEN ' ' WHEN 3 THEN 'Paused at frame 7' ELSE 'Working' END AS message,
CASE WHEN o_custkey % 4 > 0 THEN 'model_' || CAST(o_custkey % 21 AS STRING) END AS model_id,
CASE WHEN o_custkey % 6 > 0 THEN 'C:/Clips/Clip_' || CAST(o_custkey % 500 AS STRING) || '.mkv' END AS source_path,
CASE WHEN o_orderkey % 3 > 0 THEN '/scratch/job_' || CAST(o_orderkey AS STRING) END AS scratch_path,
CASE WHEN o_orderkey % 4 > 0 THEN '/out/' || o_orderstatus || CAST(o_custkey AS STRING) || '.mp4' END AS output_path,
o_custkey * 1000 AS scratch_size_bytes, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 7 ELSE 0 END AS output_size_bytes,
o_custkey * 3 + o_orderkey % 1000 AS updated_at,
CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS interpolated_frames, o_orderkey % 3 AS denoised_frames,
CASE WHEN o_custkey % 5 > 2 THEN 4 END AS colorized_frames, CASE WHEN o_orderkey % 11 > 6 THEN 9 END AS upscaled_frames
"""
JOB_SQL = f"j AS (SELECT {JOBS} FROM orders)"
JUDGED = """CASE WHEN phase = 'completed' OR percent >= 100 THEN 'succeeded'
  WHEN phase = 'failed' THEN CASE WHEN contains(lower(message), 'cancel') THEN 'cancelled' ELSE 'failed' END ELSE 'interrupted' END"""


def job_table(spark, sf):
    return stand_in(spark, sf, "orders", JOBS)


@query(
    "job_state",
    f"""WITH {JOB_SQL} SELECT job_id, CASE WHEN state IS NULL OR state IN ('queued', 'running') THEN {JUDGED} ELSE state END AS resolved_state FROM j""",
)
def job_state(spark, sf):
    return jobs.resolve_job_state(job_table(spark, sf)).select("job_id", "resolved_state")


@query(
    "pause_overlay",
    f"""WITH {JOB_SQL}, a AS (SELECT *, coalesce(state = 'paused' AND phase NOT IN ('completed', 'failed'), FALSE) AS ap FROM j)
    SELECT job_id, CASE WHEN ap THEN 'paused' ELSE phase END AS phase,
      CASE WHEN NOT ap THEN message WHEN trim(message) = '' THEN 'Job paused' WHEN contains(lower(message), 'paused') THEN message ELSE 'Job paused: ' || message END AS message FROM a""",
)
def pause_overlay(spark, sf):
    return jobs.overlay_pause(job_table(spark, sf)).select("job_id", "phase", "message")


@query(
    "recovered_jobs",
    f"""WITH {JOB_SQL}, li AS (SELECT DISTINCT l_orderkey AS job_id FROM lineitem WHERE l_returnflag = 'R'),
    a AS (SELECT j.*, li.job_id IS NOT NULL AND coalesce(state, '') <> 'paused' AS ap FROM j LEFT JOIN li USING (job_id)),
    b AS (SELECT *, ap AND (phase IN ('completed', 'failed') OR percent >= 100) AS stale FROM a)
    SELECT job_id, CASE WHEN ap THEN 'running' ELSE state END AS state,
      CASE WHEN stale THEN CASE WHEN job_kind = 'sourceConversion' THEN 'encoding' ELSE 'upscaling' END ELSE phase END AS phase,
      CAST(CASE WHEN stale THEN greatest(1, least(99, percent)) ELSE percent END AS BIGINT) AS percent,
      CASE WHEN stale THEN '{jobs.RECOVERED_MESSAGE}' ELSE message END AS message FROM b""",
)
def recovered_jobs(spark, sf):
    live = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"))
    return result(jobs.recover_running(job_table(spark, sf), live), "job_id", "state", "phase", "percent:i", "message")


@query(
    "job_kind_label",
    f"""WITH {JOB_SQL}, f AS (SELECT *, interpolated_frames > 0 AS m, denoised_frames > 0 AS d, coalesce(colorized_frames, 0) > 0 AS c,
      coalesce(upscaled_frames, 0) > 0 OR model_id IS NOT NULL AS u FROM j)
    SELECT job_id, CASE WHEN job_kind = 'sourceConversion' THEN 'Conversion' WHEN d OR c OR u OR m THEN
      array_to_string([x FOR x IN [CASE WHEN d THEN 'Denoise' END, CASE WHEN c THEN 'Colorize' END, CASE WHEN u THEN 'Upscale' END,
        CASE WHEN m AND (u OR NOT (d OR c)) THEN 'Motion' END] IF x IS NOT NULL], ' + ') ELSE 'Upscale' END AS kind_label FROM f""",
)
def job_kind_label(spark, sf):
    return jobs.job_kind_label(job_table(spark, sf)).select("job_id", "kind_label")


@query(
    "job_search",
    f"""WITH {JOB_SQL} SELECT job_id FROM j WHERE contains(lower(concat_ws(chr(10), label, coalesce(state, ''), phase, message,
    coalesce(model_id, ''), coalesce(source_path, ''), coalesce(scratch_path, ''), coalesce(output_path, ''))), 'clip_1')""",
)
def job_search(spark, sf):
    return jobs.search_jobs(job_table(spark, sf), "  Clip_1 ").select("job_id")


@query(
    "job_filter",
    f"""WITH {JOB_SQL} SELECT 'running' AS status, job_id FROM j WHERE state IN ('queued', 'running', 'paused')
    UNION ALL SELECT 'failed', job_id FROM j WHERE state IN ('failed', 'interrupted') UNION ALL SELECT 'succeeded', job_id FROM j WHERE state = 'succeeded'""",
)
def job_filter(spark, sf):
    out = None
    for status in ("running", "failed", "succeeded"):
        part = jobs.filter_jobs(job_table(spark, sf), status).select(F.lit(status).alias("status"), "job_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "job_state_counts",
    f"""WITH {JOB_SQL} SELECT job_kind, CAST(count(*) AS BIGINT) AS all_jobs, CAST(count(*) FILTER (WHERE state IN ('queued', 'running', 'paused')) AS BIGINT) AS running,
    CAST(count(*) FILTER (WHERE state = 'succeeded') AS BIGINT) AS succeeded, CAST(count(*) FILTER (WHERE state = 'cancelled') AS BIGINT) AS cancelled,
    CAST(count(*) FILTER (WHERE state IN ('failed', 'interrupted')) AS BIGINT) AS failed FROM j GROUP BY 1""",
)
def job_state_counts(spark, sf):
    return jobs.job_state_counts(job_table(spark, sf), ["job_kind"])


# Live records: the jobs with a returned line, with other numbers than the history.
LIVE_NAMES = (
    "label", "state", "phase", "message", "source_path", "scratch_path", "scratch_size_bytes", "output_path",
    "output_size_bytes", "updated_at",
)
LIVE = """l_orderkey AS job_id, max('Live ' || l_returnflag) AS label, max('running') AS state, max('upscaling') AS phase,
max(CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'Live' END) AS message, max(CASE WHEN l_orderkey % 3 > 0 THEN '/live/' || CAST(l_orderkey AS STRING) END) AS source_path,
max(CASE WHEN l_orderkey % 5 > 0 THEN '/live/scratch' END) AS scratch_path, max(CASE WHEN l_orderkey % 4 > 0 THEN l_partkey ELSE 0 END) AS scratch_size_bytes,
max(CASE WHEN l_orderkey % 7 > 0 THEN '/live/out' END) AS output_path, max(CASE WHEN l_orderkey % 6 > 2 THEN l_suppkey ELSE 0 END) AS output_size_bytes,
max(l_partkey) AS updated_at"""
HISTORY_SQL = f"h AS (SELECT * FROM j WHERE state IN ('succeeded', 'failed', 'cancelled', 'interrupted'))"


@query(
    "live_overlay",
    f"""WITH {JOB_SQL}, {HISTORY_SQL}, l AS (SELECT {LIVE} FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
    SELECT job_id, coalesce(l.label, h.label) AS label, coalesce(l.state, h.state) AS state, coalesce(l.phase, h.phase) AS phase,
      coalesce(nullif(l.message, ''), h.message, '') AS message, coalesce(l.source_path, h.source_path) AS source_path,
      coalesce(l.scratch_path, h.scratch_path) AS scratch_path, CAST(coalesce(nullif(l.scratch_size_bytes, 0), nullif(h.scratch_size_bytes, 0), 0) AS BIGINT) AS scratch_size_bytes,
      coalesce(l.output_path, h.output_path) AS output_path, CAST(coalesce(nullif(l.output_size_bytes, 0), nullif(h.output_size_bytes, 0), 0) AS BIGINT) AS output_size_bytes,
      CAST(greatest(coalesce(l.updated_at, h.updated_at), coalesce(h.updated_at, l.updated_at)) AS BIGINT) AS updated_at
    FROM h FULL JOIN l USING (job_id)""",
)
def live_overlay(spark, sf):
    history = jobs.filter_jobs(job_table(spark, sf), "failed").unionByName(
        job_table(spark, sf).where("state IN ('succeeded', 'cancelled')")
    )
    live = (
        table(spark, sf, "lineitem")
        .where("l_returnflag = 'R'")
        .groupBy(F.col("l_orderkey").alias("job_id"))
        .agg(*[F.expr(c) for c in split_columns(LIVE)[1:]])
    )
    return jobs.overlay_live_jobs(history.select("job_id", *LIVE_NAMES), live.select("job_id", *LIVE_NAMES))


@query(
    "job_records",
    f"""WITH {JOB_SQL}, {HISTORY_SQL}, g AS (SELECT * FROM j WHERE phase IN ('completed', 'failed'))
    SELECT job_id, label, state FROM h UNION ALL SELECT job_id, 'Upscale Job', {JUDGED} FROM g WHERE job_id NOT IN (SELECT job_id FROM h)""",
)
def job_records(spark, sf):
    base = job_table(spark, sf)
    summaries = base.where("state IN ('succeeded', 'failed', 'cancelled', 'interrupted')").select("job_id", "label", "state")
    legacy = jobs.resolve_job_state(
        base.where("phase IN ('completed', 'failed')").withColumn("state", F.lit(None).cast("string"))
    ).select("job_id", F.lit("Upscale Job").alias("label"), F.col("resolved_state").alias("state"))
    return jobs.union_job_records(summaries, legacy)


def _register_sort(column: str, direction: str, key_sql: str) -> None:
    order = f"{key_sql}, -updated_at, lower(CAST(job_id AS VARCHAR)), job_id"
    position = f"row_number() OVER (ORDER BY {order})"
    if direction == "desc":
        position = f"count(*) OVER () + 1 - {position}"

    @query(
        f"sorted_jobs_{column}_{direction}".lower(),
        f"WITH {JOB_SQL} SELECT job_id, CAST({position} AS BIGINT) AS position FROM j",
    )
    def sorted_jobs(spark, sf):
        base = job_table(spark, sf)
        return jobs.sort_jobs(base, column, direction).select("job_id", "position")


BASENAME = "lower(regexp_extract(coalesce({c}, ''), '([^/]*)$', 1))"
_register_sort("scratchSize", "desc", "scratch_size_bytes")
_register_sort("state", "asc", "lower(state) NULLS FIRST, lower(label)")
_register_sort("output", "desc", BASENAME.format(c="output_path"))


@query(
    "latest_jobs",
    """SELECT o_orderkey AS job_id, CAST(CASE WHEN o_orderkey % 10 = 3 THEN 0 ELSE o_custkey * 3 + o_orderkey % 1000 END AS BIGINT) AS updated FROM orders
    ORDER BY updated DESC, job_id LIMIT 50""",
)
def latest_jobs(spark, sf):
    text = "CASE WHEN o_orderkey % 10 = 3 THEN 'unknown' ELSE CAST(o_custkey * 3 + o_orderkey % 1000 AS STRING) END AS updated_at"
    top = jobs.latest_jobs(stand_in(spark, sf, "orders", f"o_orderkey AS job_id, {text}"), 50)
    return top.select("job_id", F.coalesce(F.col("updated_at").try_cast("bigint"), F.lit(0)).alias("updated"))


@query(
    "active_job",
    f"WITH {JOB_SQL} SELECT job_id, state FROM j WHERE state IN ('queued', 'running', 'paused') ORDER BY updated_at DESC, job_id LIMIT 1",
)
def active_job(spark, sf):
    return jobs.active_job(job_table(spark, sf)).select("job_id", "state")


@query(
    "storage_summary",
    """WITH f AS (SELECT lang || '/' || source AS root, n_chars AS length FROM documents), s AS (SELECT root, count(*) AS n, sum(length) AS b FROM f GROUP BY 1),
    r AS (SELECT root FROM s UNION SELECT n_name FROM nation)
    SELECT r.root, s.root IS NOT NULL AS "exists", CAST(coalesce(n, 0) AS BIGINT) AS files, CAST(coalesce(b, 0) AS BIGINT) AS size_bytes FROM r LEFT JOIN s USING (root)""",
)
def storage_summary(spark, sf):
    files = stand_in(spark, sf, "documents", "lang || '/' || source AS root, n_chars AS length")
    roots = files.select("root").union(table(spark, sf, "nation").select("n_name"))
    return jobs.storage_summary(files, roots)


CHANGES = """CAST(user_id AS {text}) AS model_id, event_id AS changed_at, CAST(event_id % 6 AS INT) AS rating, event_type = 'signup' AS deleted"""


@query(
    "incremental_ratings",
    f"""SELECT model_id, CAST(arg_max(changed_at, changed_at) AS BIGINT) AS changed_at, CAST(arg_max(rating, changed_at) AS BIGINT) AS rating
    FROM (SELECT {CHANGES.format(text='VARCHAR')} FROM events) GROUP BY 1 HAVING NOT arg_max(deleted, changed_at)""",
)
def incremental_ratings(spark, sf):
    """Ratings and their removals in three batches, each with changes of all times."""
    path = f"{ensure_checkpoint_dir(spark)}/ratings-{uuid.uuid4().hex}"
    changes = stand_in(spark, sf, "events", CHANGES.format(text="STRING"))
    for lot in range(3):
        versions.apply_changes(changes.where(F.pmod(F.xxhash64("changed_at"), F.lit(3)) == lot), path, ["model_id"], ["changed_at"], buckets=16)
    return result(versions.read_table(spark, path), "model_id", "changed_at:i", "rating:i")


TREE = """'/' || lang || '/' || source || '/' || CAST(doc_id % 7 AS {text}) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '/' || CAST(doc_id % 11 AS {text}) END
|| '/' || CAST(doc_id AS {text}) || '.txt' AS path, n_chars AS length"""


@query(
    "storage_tree",
    f"""WITH f AS (SELECT string_split(regexp_replace(path, '/[^/]*$', ''), '/')[2:] AS d, length FROM (SELECT {TREE.format(text='VARCHAR')} FROM documents) WHERE path IS NOT NULL),
    l AS (SELECT *, unnest(range(0, len(d) + 1)) AS level FROM f)
    SELECT '/' || array_to_string(d[:level], '/') AS directory, level, CAST(count(*) FILTER (WHERE level = len(d)) AS BIGINT) AS own_files,
      CAST(coalesce(sum(length) FILTER (WHERE level = len(d)), 0) AS BIGINT) AS own_bytes, CAST(count(*) AS BIGINT) AS files, CAST(sum(length) AS BIGINT) AS size_bytes
    FROM l GROUP BY 1, 2""",
)
def storage_tree(spark, sf):
    tree = jobs.storage_tree(stand_in(spark, sf, "documents", TREE.format(text="STRING")))
    return result(tree, "directory", "level:i", "own_files:i", "own_bytes:i", "files:i", "size_bytes:i")


@query(
    "cleanup_targets",
    f"""WITH {JOB_SQL}, e AS (SELECT scratch_path AS p, scratch_size_bytes AS b FROM j UNION ALL SELECT output_path, output_size_bytes FROM j)
    SELECT CAST(count(*) AS BIGINT) AS targets, CAST(sum(b) AS BIGINT) AS total_bytes FROM e WHERE p IS NOT NULL""",
)
def cleanup_targets(spark, sf):
    return jobs.cleanup_targets(job_table(spark, sf))


# --- requests -------------------------------------------------------------------------------------------------------

KEYED = """o_orderkey AS request_id, o_orderpriority AS preset, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS target_width,
CASE WHEN o_orderkey % 2 > 0 THEN o_custkey % 4 END AS gpu_id, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / 3 END AS crop_left,
CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS codec, o_custkey % 2 = 0 AS channels_last"""
KEY_COLUMNS = ("preset", "target_width", "gpu_id", "crop_left", "codec", "channels_last")


@query(
    "request_key",
    f"""WITH k AS (SELECT {KEYED} FROM orders) SELECT request_id, substr(sha256(preset || '|' || coalesce(target_width, 0) || '|' || coalesce(gpu_id, -1) || '|' ||
    printf('%.4f', coalesce(crop_left, 0.0)::DOUBLE) || '|' || coalesce(codec, '') || '|' || CAST(channels_last::INT AS VARCHAR)), 1, 12) AS request_key FROM k""",
)
def request_key(spark, sf):
    return requests.request_key(stand_in(spark, sf, "orders", KEYED), KEY_COLUMNS).select("request_id", "request_key")


STEM = "CASE WHEN regexp_extract({n}, '^(.+)\\.[^.]*$', 1) = '' THEN {n} ELSE regexp_extract({n}, '^(.+)\\.[^.]*$', 1) END"
SANITIZE = "trim(lower(regexp_replace({v}, '[^A-Za-z0-9]', '_', 'g')), '_')"


@query(
    "source_identity",
    f"""WITH p AS (SELECT page_id, ' ' || replace(url, '/', chr(92)) || ' ' AS path FROM pages), n AS (SELECT *, regexp_extract(replace(path, chr(92), '/'), '([^/]*)$', 1) AS name,
      lower(replace(trim(path), chr(92), '/')) AS key FROM p), s AS (SELECT *, {SANITIZE.format(v=STEM.format(n='name'))} AS stem, substr(sha256(key), 1, 8) AS fp FROM n)
    SELECT page_id, key AS source_key, fp AS fingerprint, CASE WHEN stem = '' THEN 'source' ELSE stem END || '__' || fp AS library_id FROM s""",
)
def source_identity(spark, sf):
    pages = stand_in(spark, sf, "pages", "page_id, ' ' || replace(url, '/', chr(92)) || ' ' AS source_path")
    return requests.source_identity(pages).drop("source_path")


@query(
    "library_entry_keys",
    """SELECT page_id, substr(sha256(lower(url)), 1, 12) AS entry_id,
    substr(sha256(url || '|' || length(html) || '|' || page_id * 1000 || '|preview-v2'), 1, 16) AS cache_key FROM pages""",
)
def library_entry_keys(spark, sf):
    pages = stand_in(spark, sf, "pages", "page_id, url, length(html) AS length, page_id * 1000 AS modified_ns")
    out = requests.file_cache_key(requests.entry_identity(pages, "url"), "preview-v2", path="url")
    return out.select("page_id", "entry_id", "cache_key")


CODECS = """o_orderkey AS job_id, CASE o_orderkey % 8 WHEN 0 THEN ' HEVC (Main)' WHEN 1 THEN 'h264' WHEN 2 THEN 'libx265' WHEN 3 THEN 'AVC1' WHEN 4 THEN 'vp9'
WHEN 5 THEN '' WHEN 6 THEN 'H265' END AS codec, CASE o_orderkey % 6 WHEN 0 THEN CAST(1700000000 + o_orderkey AS STRING) WHEN 1 THEN CAST(1700000000000 + o_orderkey AS STRING)
WHEN 2 THEN 'yesterday' WHEN 3 THEN '-5' WHEN 4 THEN CAST(o_orderkey AS STRING) || '.25' END AS created_at"""


@query(
    "normalized_records",
    f"""WITH c AS (SELECT {CODECS} FROM orders), t AS (SELECT *, lower(trim(coalesce(codec, ''))) AS lc, TRY_CAST(created_at AS DOUBLE) AS n FROM c)
    SELECT job_id, CASE WHEN regexp_matches(lc, 'hevc|h265|x265') THEN 'h265' WHEN regexp_matches(lc, 'h264|avc|x264') THEN 'h264' END AS normalized_codec,
      round(CASE WHEN n > 0 THEN CASE WHEN n < 1000000000000 THEN n * 1000 ELSE n END ELSE 0.0 END, 3) AS millis FROM t""",
)
def normalized_records(spark, sf):
    out = requests.normalize_timestamp(requests.normalize_codec(stand_in(spark, sf, "orders", CODECS)))
    return result(out, "job_id", "normalized_codec", "millis:d3")


REQUESTS = """o_orderkey AS request_id, 'Supplier#' || lpad(CAST(o_custkey % 110 AS STRING), 9, '0') AS model_id,
CASE o_orderkey % 4 WHEN 0 THEN 'off' WHEN 1 THEN 'afterUpscale' WHEN 2 THEN 'interpolateOnly' ELSE 'sometimes' END AS interpolation_mode,
CASE o_custkey % 4 WHEN 0 THEN 30 WHEN 1 THEN 60 WHEN 2 THEN 25 END AS interpolation_target_fps, CAST(o_orderkey % 70 AS DOUBLE) AS source_fps,
CASE o_custkey % 7 WHEN 0 THEN 'fp32' WHEN 1 THEN ' BF16' WHEN 2 THEN 'int8' END AS precision, o_orderkey % 9 = 0 AS fp16, o_custkey % 11 = 0 AS bf16,
CASE WHEN o_orderkey % 3 = 0 THEN 'off' ELSE 'on' END AS denoise_mode, CASE WHEN o_custkey % 5 > 0 THEN 'Supplier#' || lpad(CAST(o_orderkey % 120 AS STRING), 9, '0') END AS denoiser_model_id,
CASE o_custkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'beforeUpscale' ELSE 'colorizeOnly' END AS colorization_mode,
CASE WHEN o_orderkey % 6 > 0 THEN 'Supplier#' || lpad(CAST((o_orderkey + o_custkey) % 105 AS STRING), 9, '0') END AS colorizer_model_id"""
REQUEST_MODELS = """s_name AS model_id, CASE s_nationkey % 3 WHEN 0 THEN 'upscale' WHEN 1 THEN 'denoise' ELSE 'colorize' END AS task,
CASE WHEN s_acctbal > 1000 THEN 'runnable' ELSE 'planned' END AS execution_status"""


def _helper_sql(flag: str, side: str, alias: str, task: str) -> str:
    return f"""CASE WHEN {flag} AND {side}_model_id IS NULL THEN 'missing {side}' END,
      CASE WHEN {flag} AND {side}_model_id IS NOT NULL AND {alias}.model_id IS NULL THEN 'unknown {side}' END,
      CASE WHEN {flag} AND {alias}.execution_status <> 'runnable' THEN '{side} not runnable' END,
      CASE WHEN {flag} AND {alias}.task <> '{task}' THEN '{side} has another task' END"""


@query(
    "request_validation",
    f"""WITH r AS (SELECT {REQUESTS} FROM orders), m AS (SELECT {REQUEST_MODELS} FROM supplier),
    x AS (SELECT *, nullif(lower(trim(precision)), '') AS pr, interpolation_mode <> 'off' AS mo, colorization_mode <> 'colorizeOnly' AS up,
      denoise_mode <> 'off' AS dn, colorization_mode <> 'off' AS co FROM r)
    SELECT request_id, array_to_string(list_filter([
      CASE WHEN interpolation_mode NOT IN ('off', 'afterUpscale', 'interpolateOnly') THEN 'unsupported interpolation mode' END,
      CASE WHEN mo AND (interpolation_target_fps IS NULL OR interpolation_target_fps NOT IN (30, 60)) THEN 'unsupported target fps' END,
      CASE WHEN mo AND interpolation_target_fps < source_fps - 0.01 THEN 'target fps below source' END,
      CASE WHEN pr NOT IN ('fp32', 'fp16', 'bf16') THEN 'unsupported precision' END, CASE WHEN fp16 AND bf16 THEN 'fp16 and bf16 conflict' END,
      CASE WHEN fp16 AND pr <> 'fp16' THEN 'precision conflicts with fp16' END, CASE WHEN bf16 AND pr <> 'bf16' THEN 'precision conflicts with bf16' END,
      CASE WHEN up AND a.model_id IS NULL THEN 'unknown model' END, CASE WHEN up AND a.execution_status <> 'runnable' THEN 'model not runnable' END,
      {_helper_sql('dn', 'denoiser', 'b', 'denoise')}, {_helper_sql('co', 'colorizer', 'c', 'colorize')}], lambda e: e IS NOT NULL), '; ') AS errors,
      CASE WHEN mo AND source_fps >= interpolation_target_fps THEN 'source already at target fps' ELSE '' END AS warnings
    FROM x LEFT JOIN m a ON a.model_id = x.model_id LEFT JOIN m b ON b.model_id = x.denoiser_model_id LEFT JOIN m c ON c.model_id = x.colorizer_model_id""",
)
def request_validation(spark, sf):
    models = stand_in(spark, sf, "supplier", REQUEST_MODELS)
    out = requests.validate_requests(stand_in(spark, sf, "orders", REQUESTS), models)
    return out.select(
        "request_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings")
    )


@query(
    "missing_references",
    """WITH r AS (SELECT o_orderkey AS request_id, unnest(['Part ' || o_custkey, 'Part ' || (o_orderkey % 3000), 'Part ' || (o_custkey * 2)]) AS path FROM orders)
    SELECT request_id, path FROM r WHERE path NOT IN (SELECT 'Part ' || p_partkey FROM part)""",
)
def missing_references(spark, sf):
    wanted = stand_in(
        spark,
        sf,
        "orders",
        "o_orderkey AS request_id, array('Part ' || CAST(o_custkey AS STRING), 'Part ' || CAST(o_orderkey % 3000 AS STRING), "
        "'Part ' || CAST(o_custkey * 2 AS STRING)) AS reference_paths",
    )
    files = stand_in(spark, sf, "part", "'Part ' || CAST(p_partkey AS STRING) AS path")
    return requests.missing_references(wanted, files)


LISTS = """l_orderkey AS id, l_partkey, l_linenumber, CASE WHEN l_linenumber = 7 AND l_partkey % 50 = 0 THEN ' , ' WHEN l_partkey % 40 = 1 THEN '128, x'
ELSE ' ' || CAST(l_partkey AS STRING) || ',128, ' || CAST(l_suppkey AS STRING) || ',' || CAST(l_partkey % 9 AS STRING) || ',,128' END AS tiles,
CASE l_linenumber WHEN 1 THEN 'Streaming,file-io,STREAMING' WHEN 2 THEN 'file-io' WHEN 3 THEN '' WHEN 4 THEN 'gpu' ELSE ' file-io , streaming' END AS paths"""


@query(
    "distinct_lists",
    f"""WITH l AS (SELECT {LISTS} FROM lineitem), s AS (SELECT *, list_filter(list_transform(string_split(tiles, ','), lambda t: trim(t)), lambda t: t <> '') AS it,
      list_filter(list_transform(string_split(paths, ','), lambda t: lower(trim(t))), lambda t: t <> '') AS ip FROM l),
    n AS (SELECT *, list_transform(it, lambda t: TRY_CAST(t AS INT)) AS nu FROM s)
    SELECT id, l_partkey, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN len(it) > 0 AND len(list_filter(nu, lambda x: x IS NULL)) = 0 THEN array_to_string(list_sort(list_distinct(nu)), ',') END AS tiles,
      CASE WHEN len(list_filter(nu, lambda x: x IS NULL)) > 0 THEN 'not an integer' WHEN len(it) = 0 THEN 'at least one value is required' END AS tile_error,
      CASE l_linenumber WHEN 1 THEN 'streaming,file-io' WHEN 2 THEN 'file-io' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'file-io,streaming' END AS paths,
      CASE l_linenumber WHEN 3 THEN 'at least one value is required' WHEN 4 THEN 'unsupported value' END AS path_error FROM n""",
)
def distinct_lists(spark, sf):
    base = stand_in(spark, sf, "lineitem", LISTS)
    tiles = requests.distinct_sorted(base, "tiles", "tile_values").withColumnRenamed("error", "tile_error")
    out = requests.distinct_in_order(tiles, "paths", ("file-io", "streaming"), "path_values")
    return out.select(
        "id",
        "l_partkey",
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.array_join(F.transform("tile_values", lambda v: v.cast("string")), ",").alias("tiles"),
        "tile_error",
        F.array_join("path_values", ",").alias("paths"),
        F.col("error").alias("path_error"),
    )


SETS_SPARK = """l_orderkey, l_linenumber, l_partkey, array(l_suppkey, l_partkey % 5, l_linenumber) AS a,
array(l_partkey % 5, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber ELSE l_partkey % 5 END, l_suppkey) AS b"""


@query(
    "same_candidate_sets",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
    list_sort([l_suppkey, l_partkey % 5, l_linenumber]) = list_sort([l_partkey % 5, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber ELSE l_partkey % 5 END, l_suppkey]) AS same FROM lineitem""",
)
def same_candidate_sets(spark, sf):
    pairs = stand_in(spark, sf, "lineitem", SETS_SPARK).withColumn("same", requests.same_candidate_set("a", "b"))
    return result(pairs, "l_orderkey", "l_linenumber:i", "l_partkey", "same")


SIGNED = """o_orderkey AS id, 'clip_' || o_orderpriority AS source_path, CAST(o_custkey % 9 AS DOUBLE) / 2 AS preview_duration_seconds,
CAST(o_orderkey % 1000 AS DOUBLE) / 8 AS preview_start_offset_seconds, CASE WHEN o_custkey % 2 = 0 THEN 'off' ELSE 'beforeUpscale' END AS colorization_mode,
'off' AS interpolation_mode, 'swin' || CAST(o_custkey % 20 AS STRING) AS upscale_model_id, CASE WHEN o_custkey % 3 > 0 THEN 'standard' END AS processing_mode"""


@query(
    "comparison_signature",
    f"""WITH s AS (SELECT {SIGNED}, ['m' || (o_custkey % 7), 'm' || (o_orderkey % 5), 'base'] AS candidates, ['e' || (o_orderkey % 3), 'a'] AS entries,
      o_custkey % 4 = 0 AS has_context FROM orders), n AS (SELECT *, round(preview_start_offset_seconds, 3) AS o FROM s)
    SELECT id, '{{"sourcePath":' || to_json(source_path) || ',"previewDurationSeconds":' ||
      CASE WHEN preview_duration_seconds = floor(preview_duration_seconds) THEN CAST(CAST(preview_duration_seconds AS BIGINT) AS VARCHAR) ELSE CAST(preview_duration_seconds AS VARCHAR) END ||
      ',"previewStartOffsetSeconds":' || CASE WHEN o = floor(o) THEN CAST(CAST(o AS BIGINT) AS VARCHAR) ELSE CAST(o AS VARCHAR) END ||
      ',"colorizationMode":' || to_json(colorization_mode) || ',"interpolationMode":' || to_json(interpolation_mode) || ',"upscaleModelId":' || to_json(upscale_model_id) ||
      ',"candidateModelIds":' || to_json(list_sort(candidates)) || ',"deepremasterProcessingMode":' || coalesce(to_json(processing_mode), 'null') || ',"colorizationContext":' ||
      CASE WHEN has_context THEN '{{"libraryId":"lib","selectedEntryIds":' || to_json(list_sort(entries)) || ',"referenceImagePaths":' || to_json(list_sort(candidates)) || '}}' ELSE 'null' END || '}}' AS signature FROM n""",
)
def comparison_signature(spark, sf):
    extra = """array('m' || CAST(o_custkey % 7 AS STRING), 'm' || CAST(o_orderkey % 5 AS STRING), 'base') AS candidates,
    array('e' || CAST(o_orderkey % 3 AS STRING), 'a') AS entries, o_custkey % 4 = 0 AS has_context"""
    base = stand_in(spark, sf, "orders", f"{SIGNED}, {extra}").withColumn(
        "context",
        F.when(
            F.col("has_context"),
            F.struct(
                F.lit("lib").alias("library_id"), F.col("entries").alias("entry_ids"), F.col("candidates").alias("reference_paths")
            ),
        ),
    )
    return requests.comparison_signature(base).select("id", "signature")


# --- catalog --------------------------------------------------------------------------------------------------------

MODELS = """s_suppkey AS model_id, s_name AS label, CASE WHEN s_nationkey % 6 = 0 THEN 'pytorch-video-sr' ELSE 'NATION_' || CAST(s_nationkey + s_suppkey % 3 AS STRING) END AS backend_id,
CASE s_suppkey % 4 WHEN 0 THEN 'colorize' WHEN 1 THEN 'denoise' WHEN 2 THEN 'upscale' END AS task, CASE WHEN s_acctbal > 6000 THEN TRUE WHEN s_acctbal > 2000 THEN FALSE END AS visible_in_ui,
s_suppkey % 3 = 0 AS comparison_eligible, CASE s_nationkey % 3 WHEN 0 THEN 'runnable' WHEN 1 THEN 'planned' END AS execution_status,
CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey % 13 AS INT) END AS quality_rank, CASE WHEN s_suppkey % 2 = 0 THEN 'research' END AS support_tier"""
MODEL_SQL = f"""mo AS (SELECT model_id, label, backend_id, coalesce(task, 'upscale') AS task, coalesce(visible_in_ui, FALSE) AS vis, comparison_eligible AS cmp,
  coalesce(execution_status, 'planned') AS st, coalesce(quality_rank, 999) AS rk, coalesce(support_tier, 'next') AS tier FROM (SELECT {MODELS} FROM supplier))"""
RULES = {
    "visible": "vis",
    "ui": "vis OR st = 'planned'",
    "runnable": "st = 'runnable'",
    "comparison": "cmp AND st = 'runnable'",
    "top_rated": "rk <= 6",
    "benchmarkable": "st = 'runnable' OR (backend_id = 'pytorch-video-sr' AND tier = 'research')",
}


def model_table(spark, sf):
    return stand_in(spark, sf, "supplier", MODELS)


@query(
    "catalog_lists",
    f"WITH {MODEL_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS list, task, model_id FROM mo WHERE ({r})" for k, r in RULES.items()),
)
def catalog_lists(spark, sf):
    out = None
    for kind in RULES:
        part = catalog.catalog_filter(model_table(spark, sf), kind, None).select(F.lit(kind).alias("list"), "task", "model_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "models_with_backends",
    f"""WITH {MODEL_SQL} SELECT model_id, backend_id, r_name AS backend_label, n_nationkey IS NULL AS unknown FROM mo
    LEFT JOIN nation ON n_name = backend_id LEFT JOIN region ON r_regionkey = n_regionkey""",
)
def models_with_backends(spark, sf):
    backends = (
        table(spark, sf, "nation")
        .join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
        .select(F.col("n_name").alias("backend_id"), F.col("r_name").alias("label"))
    )
    known, unknown = catalog.models_with_backends(model_table(spark, sf), backends)
    return known.select("model_id", "backend_id", "backend_label", F.lit(False).alias("unknown")).unionByName(
        unknown.select("model_id", "backend_id", F.lit(None).cast("string").alias("backend_label"), F.lit(True).alias("unknown"))
    )


@query(
    "ranked_models",
    f"WITH {MODEL_SQL} SELECT model_id, task, CAST(row_number() OVER (PARTITION BY task ORDER BY rk, lower(label), model_id) AS BIGINT) AS rank_position FROM mo",
)
def ranked_models(spark, sf):
    return catalog.rank_models(catalog.with_defaults(model_table(spark, sf))).select("model_id", "task", "rank_position")


# --- library --------------------------------------------------------------------------------------------------------

FILES = """source AS library_id, doc_id AS seq, CASE doc_id % 7 WHEN 0 THEN lang || ' scan.PNG' WHEN 1 THEN '_' || lang || '-scan.png' WHEN 2 THEN lang || '_scan_3.png'
WHEN 3 THEN lang WHEN 4 THEN '##.png' ELSE lang || '_scan.png' END AS file_name, text AS content"""
# the library already holds the labelled documents, under their import names
IMPORT_SQL = f"""fi AS (SELECT {FILES} FROM documents), li AS (SELECT library_id, sha256(content) AS h, lower(lang) || '_scan' || CASE WHEN seq % 2 = 0 THEN '_2' ELSE '' END || '.png' AS name
    FROM (SELECT {FILES}, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))),
  fr AS (SELECT library_id, sha256(content) AS h, min(seq) AS seq, arg_min(file_name, seq) AS file_name FROM fi GROUP BY 1, 2),
  ne AS (SELECT fr.* FROM fr ANTI JOIN li ON li.library_id = fr.library_id AND li.h = fr.h),
  st AS (SELECT *, {SANITIZE.format(v=STEM.format(n='file_name'))} AS s0, lower(regexp_extract(file_name, '^.+\\.([^.]*)$', 1)) AS ext FROM ne),
  sn AS (SELECT *, CASE WHEN s0 = '' THEN 'context' ELSE s0 END AS stem FROM st),
  ex AS (SELECT DISTINCT library_id, regexp_replace(name, '\\.png$', '') AS stem, 'png' AS ext FROM li),
  nm AS (SELECT library_id, stem, ext FROM ex UNION SELECT library_id, stem, ext FROM sn),
  tk AS (SELECT library_id, stem, ext, 1 AS n FROM ex UNION SELECT library_id, regexp_extract(stem, '^(.+)_[1-9][0-9]*$', 1), ext, CAST(regexp_extract(stem, '^.+_([1-9][0-9]*)$', 1) AS BIGINT)
    FROM nm WHERE regexp_matches(stem, '^.+_[1-9][0-9]*$') AND CAST(regexp_extract(stem, '^.+_([1-9][0-9]*)$', 1) AS BIGINT) >= 2),
  tl AS (SELECT library_id, stem, ext, list(n) AS ns FROM tk GROUP BY 1, 2, 3),
  kk AS (SELECT sn.*, ns, row_number() OVER (PARTITION BY library_id, stem, ext ORDER BY seq) AS k, count(*) OVER (PARTITION BY library_id, stem, ext) AS c
    FROM sn LEFT JOIN tl USING (library_id, stem, ext)),
  ix AS (SELECT *, list_filter(range(1, c + coalesce(len(ns), 0) + 1), lambda i: NOT list_contains(coalesce(ns, []), i))[k] AS n FROM kk)"""


@query(
    "deduped_imports",
    f"""WITH {IMPORT_SQL} SELECT library_id, CAST(seq AS BIGINT) AS seq, h AS content_hash,
    stem || CASE WHEN n > 1 THEN '_' || n ELSE '' END || CASE WHEN ext <> '' THEN '.' || ext ELSE '' END AS name FROM ix""",
)
def deduped_imports(spark, sf):
    files = stand_in(spark, sf, "documents", FILES)
    labelled = stand_in(spark, sf, "documents", f"{FILES}, lang, doc_id").join(
        table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi"
    )
    existing = labelled.select(
        "library_id",
        F.expr("lower(lang) || '_scan' || CASE WHEN seq % 2 = 0 THEN '_2' ELSE '' END || '.png'").alias("name"),
        library.content_hash("content").alias("content_hash"),
    )
    return library.dedupe_import(existing, files).select("library_id", "seq", "content_hash", "name")


RATINGS = """user_id AS model_id, event_id, ts AS updated_at, CASE WHEN event_type <> 'error' THEN 1 + CAST(floor(value) AS BIGINT) % 5 END AS rating"""


@query(
    "model_ratings",
    f"""WITH r AS (SELECT {RATINGS} FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY updated_at DESC, event_id DESC) AS rn FROM r)
    SELECT model_id, CAST(rating AS BIGINT) AS rating FROM l WHERE rn = 1 AND rating IS NOT NULL""",
)
def model_ratings(spark, sf):
    out = library.model_ratings(stand_in(spark, sf, "events", RATINGS), order=("updated_at", "event_id"))
    return out.select("model_id", "rating")


@query(
    "pick_tally",
    """WITH w AS (SELECT l_orderkey, arg_max(l_suppkey, (l_extendedprice, -l_linenumber, l_suppkey)) AS winner FROM lineitem GROUP BY 1)
    SELECT l_suppkey AS model_id, CAST(count(*) AS BIGINT) AS appearances, CAST(count(*) FILTER (WHERE winner = l_suppkey) AS BIGINT) AS wins
    FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN w USING (l_orderkey) GROUP BY 1""",
)
def pick_tally(spark, sf):
    best = F.max_by("l_suppkey", F.struct("l_extendedprice", -F.col("l_linenumber"), "l_suppkey"))
    lines = table(spark, sf, "lineitem")
    winners = lines.groupBy("l_orderkey").agg(best.alias("model_id"))
    candidates = lines.select(F.col("l_orderkey").alias("record_id"), F.col("l_suppkey").alias("model_id"))
    return library.candidate_tally(candidates, winners)


@query(
    "picks_logged",
    "SELECT o_custkey AS source_path, CAST(count(*) AS BIGINT) AS picks FROM orders GROUP BY 1",
)
def picks_logged(spark, sf):
    return library.picks_logged(stand_in(spark, sf, "orders", "o_custkey AS source_path, o_orderkey AS record"))


PICKS = """o_orderkey AS record_order, 'clip' || CAST(o_custkey % 40 AS STRING) AS source_path, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS signature,
CAST(4 + o_orderkey % 2 * 4 AS DOUBLE) AS duration_seconds, CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_orderkey % 40 AS DOUBLE) / 16 END AS start_offset_seconds, o_orderstatus AS winner"""
SESSIONS = """c_custkey AS session_id, 'clip' || CAST(c_custkey % 40 AS STRING) AS source_path, CASE c_nationkey % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM'
  WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN 'other' END AS signature, CAST(4 + c_custkey % 2 * 4 AS DOUBLE) AS duration_seconds, CAST(c_custkey % 64 AS DOUBLE) / 24 AS start_offset_seconds,
CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 725846400000 + c_custkey % 1200 * 259200000 END AS started_ms"""


@query(
    "matched_picks",
    f"""WITH p AS (SELECT {PICKS}, epoch_ms(o_orderdate) AS created_ms, list_sort([o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE 'y' END]) AS cs FROM orders),
    s AS (SELECT {SESSIONS}, list_sort([CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE 'y' END, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END]) AS cs FROM customer),
    m AS (SELECT s.session_id, max(p.record_order) AS record_order FROM s JOIN p ON p.source_path = s.source_path
      AND (s.started_ms <= 0 OR (p.created_ms > 0 AND p.created_ms >= s.started_ms - 1000))
      AND CASE WHEN p.signature IS NOT NULL THEN coalesce(p.signature = s.signature, FALSE)
        ELSE p.duration_seconds = s.duration_seconds AND abs(coalesce(p.start_offset_seconds, 0) - s.start_offset_seconds) < 0.25 AND p.cs = s.cs END GROUP BY 1)
    SELECT s.session_id, CAST(m.record_order AS BIGINT) AS record_order, p.winner FROM s LEFT JOIN m USING (session_id) LEFT JOIN p USING (record_order)""",
)
def matched_picks(spark, sf):
    picks = stand_in(
        spark,
        sf,
        "orders",
        f"{PICKS}, unix_millis(CAST(o_orderdate AS TIMESTAMP)) AS created_ms, "
        "array(o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE 'y' END) AS candidates",
    )
    sessions = stand_in(
        spark,
        sf,
        "customer",
        f"{SESSIONS}, array(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE 'y' END, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END) AS candidates",
    )
    return library.match_blind_record(sessions, picks, block_ms=30 * 86_400_000)


@query(
    "shuffled_candidates",
    """SELECT o_custkey AS session_id, o_orderkey AS model_id, CAST(row_number() OVER (PARTITION BY o_custkey
    ORDER BY sha256('seed-1|' || o_custkey || '|' || o_orderkey), o_orderkey) AS BIGINT) AS position FROM orders""",
)
def shuffled_candidates(spark, sf):
    base = stand_in(spark, sf, "orders", "o_custkey AS session_id, o_orderkey AS model_id")
    return library.shuffle_candidates(base, "seed-1")


# --- segment outputs ------------------------------------------------------------------------------------------------

OUTPUTS = "l_suppkey AS source_id, CAST(l_linenumber AS BIGINT) AS segment_index, l_orderkey * 100000 + l_partkey AS frame_index"
OUT_SQL = f"ou AS (SELECT DISTINCT {OUTPUTS} FROM lineitem)"


def outputs(spark, sf):
    return stand_in(spark, sf, "lineitem", OUTPUTS).distinct()


@query(
    "ordered_sequence",
    f"""WITH {OUT_SQL} SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY segment_index, frame_index) - 1 AS BIGINT) AS sequence_index FROM ou""",
)
def ordered_sequence(spark, sf):
    return completeness.ordered_concat(outputs(spark, sf))


@query(
    "segment_manifest",
    f"""WITH {OUT_SQL}, c AS (SELECT source_id, segment_index, count(*) AS n FROM ou GROUP BY 1, 2)
    SELECT source_id, segment_index, CAST(n AS BIGINT) AS frames, CAST(coalesce(sum(n) OVER (PARTITION BY source_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index FROM c""",
)
def segment_manifest(spark, sf):
    return completeness.segment_manifest(outputs(spark, sf))


STAGE_IN = "SELECT DISTINCT l_suppkey AS source_id, l_orderkey AS frame_index FROM lineitem WHERE l_returnflag IN ('A', 'R')"
STAGE_OUT = "SELECT DISTINCT l_suppkey AS source_id, l_orderkey AS frame_index FROM lineitem WHERE l_returnflag IN ('A', 'N')"


def _stage(spark, sf, flags):
    return (
        table(spark, sf, "lineitem")
        .where(F.col("l_returnflag").isin(*flags))
        .select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("frame_index"))
        .distinct()
    )


@query(
    "output_completeness",
    f"""WITH i AS ({STAGE_IN}), o AS ({STAGE_OUT}), j AS (SELECT coalesce(i.source_id, o.source_id) AS source_id, i.source_id IS NOT NULL AS a, o.source_id IS NOT NULL AS b
      FROM i FULL JOIN o ON i.source_id = o.source_id AND i.frame_index = o.frame_index)
    SELECT source_id, CAST(count(*) FILTER (WHERE a) AS BIGINT) AS input_frames, CAST(count(*) FILTER (WHERE b) AS BIGINT) AS output_frames,
      CAST(count(*) FILTER (WHERE NOT b) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE NOT a) AS BIGINT) AS extra,
      count(*) FILTER (WHERE b) > 0 AND count(*) FILTER (WHERE a) = count(*) FILTER (WHERE b) AS complete FROM j GROUP BY 1""",
)
def output_completeness(spark, sf):
    return completeness.output_completeness(_stage(spark, sf, ("A", "R")), _stage(spark, sf, ("A", "N")))


@query(
    "frame_differences",
    f"""WITH i AS ({STAGE_IN}), o AS ({STAGE_OUT}) SELECT *, 'missing' AS problem FROM (SELECT * FROM i EXCEPT SELECT * FROM o)
    UNION ALL SELECT *, 'extra' FROM (SELECT * FROM o EXCEPT SELECT * FROM i)""",
)
def frame_differences(spark, sf):
    def dealt(flags):
        """Distinct frames, found in partitions whose number follows the rows."""
        lines = table(spark, sf, "lineitem")
        parts = max(1, -(-lines.count() // completeness.FRAMES_PER_TASK))
        kept = lines.where(F.col("l_returnflag").isin(*flags)).select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("frame_index"))
        return kept.repartition(parts, "source_id", "frame_index").distinct()

    return completeness.frame_differences(dealt(("A", "R")), dealt(("A", "N")))


@query(
    "remaining_segments",
    """WITH p AS (SELECT DISTINCT l_suppkey AS source_id, CAST(l_orderkey // 24 AS BIGINT) AS segment_index FROM lineitem),
    d AS (SELECT l_suppkey AS source_id, CAST(l_orderkey // 24 AS BIGINT) AS segment_index, l_quantity - 45 AS size_bytes, CASE WHEN l_tax < 0.06 THEN l_tax < 0.04 END AS seams_ok FROM lineitem WHERE l_linestatus = 'F')
    SELECT * FROM p WHERE (source_id, segment_index) NOT IN (SELECT (source_id, segment_index) FROM d WHERE size_bytes > 0 AND coalesce(seams_ok, TRUE))""",
)
def remaining_segments(spark, sf):
    lines = table(spark, sf, "lineitem").withColumns(
        {"source_id": F.col("l_suppkey"), "segment_index": F.floor(F.col("l_orderkey") / 24).cast("bigint")}
    )
    done = lines.where("l_linestatus = 'F'").selectExpr(
        "source_id", "segment_index", "l_quantity - 45 AS size_bytes", "CASE WHEN l_tax < 0.06 THEN l_tax < 0.04 END AS seams_ok"
    )
    return completeness.remaining_segments(lines.select("source_id", "segment_index").distinct(), done)


STORED = """CAST(l_suppkey AS {text}) AS source_id, CAST(l_linenumber AS BIGINT) AS segment_index, l_orderkey * 100000 + l_partkey AS frame_index,
l_suppkey % 4 <> 0 OR l_tax < 0.08 AS seams_ok"""


@query(
    "segment_ledger",
    f"""WITH f AS (SELECT source_id, segment_index, frame_index, bool_and(seams_ok) AS ok FROM (SELECT {STORED.format(text='VARCHAR')} FROM lineitem) GROUP BY ALL),
    s AS (SELECT source_id, segment_index, count(*) AS n, bool_and(ok) AS ok, CAST(source_id AS BIGINT) AS k FROM f GROUP BY ALL),
    a AS (SELECT *, CASE WHEN (k + segment_index) % 5 = 0 THEN 'frame count' WHEN NOT ok THEN 'seams' END AS early FROM s),
    b AS (SELECT *, early IS NOT NULL AND k % 2 = 0 AS again, CASE WHEN NOT ok THEN 'seams' END AS late FROM a),
    c AS (SELECT *, early IS NULL OR (again AND late IS NULL) AS present FROM b)
    SELECT source_id, segment_index, CAST(1 + again::INT AS BIGINT) AS versions, present, CASE WHEN again THEN late ELSE early END AS refused,
      CASE WHEN present THEN n END AS frames, NOT present AS remaining FROM c""",
)
def segment_ledger(spark, sf):
    """Segments with a planned count and a seam check per frame; what is refused is planned anew for even sources and written again."""
    store = f"{ensure_checkpoint_dir(spark)}/segments-{uuid.uuid4().hex}"
    keys = ("source_id", "segment_index")
    lines = stand_in(spark, sf, "lineitem", STORED.format(text="STRING"))
    frames = lines.groupBy(*keys, "frame_index").agg(F.bool_and("seams_ok").alias("seams_ok"))
    plans = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("planned_frames"))
    source = F.col("source_id").cast("bigint")
    wrong = F.when((source + F.col("segment_index")) % 5 == 0, 1).otherwise(0)
    first = plans.withColumn("planned_frames", F.col("planned_frames") + wrong)
    segments.commit_segments(frames.join(first, list(keys)), store)
    left = completeness.remaining_segments(plans, segments.current_segments(segments.read_ledger(spark, store)))
    segments.commit_segments(frames.join(left.where(source % 2 == 0), list(keys)), store)
    ledger = segments.read_ledger(spark, store)
    left = completeness.remaining_segments(plans, segments.current_segments(ledger)).select(*keys, F.lit(True).alias("remaining"))
    out = segments.segment_states(ledger).join(left, list(keys), "left").withColumn("remaining", F.coalesce("remaining", F.lit(False)))
    return result(out, "source_id", "segment_index:i", "versions:i", "present", "refused", "frames:i", "remaining")


@query(
    "limited_frames",
    """SELECT source_id, frame_index FROM (SELECT l_suppkey AS source_id, l_orderkey AS frame_index, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber) AS n FROM lineitem) WHERE n <= 25""",
)
def limited_frames(spark, sf):
    lines = stand_in(spark, sf, "lineitem", "l_suppkey AS source_id, l_orderkey AS frame_index, l_partkey, l_linenumber")
    out = completeness.limit_frames(lines, 25, order=("frame_index", "l_partkey", "l_linenumber"))
    return out.select("source_id", "frame_index")


@query(
    "representative_frames",
    f"""WITH {OUT_SQL}, f AS (SELECT DISTINCT source_id, frame_index FROM ou), n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY frame_index) - 1 AS k, count(*) OVER (PARTITION BY source_id) AS c FROM f)
    SELECT source_id, frame_index FROM n WHERE k = least(c - 1, c // 2)""",
)
def representative_frames(spark, sf):
    frames = outputs(spark, sf).select("source_id", "frame_index").distinct()
    # an order takes 100,000 numbers, so a block has the frames of 4,096 order keys
    return completeness.representative_frame(frames, block=4_096 * 100_000)


PROBES = """page_id AS id, url || CASE page_id % 3 WHEN 0 THEN '.MKV' WHEN 1 THEN '.mp4' ELSE '' END AS path,
CASE WHEN page_id % 11 = 5 THEN html ELSE 'Input #0, from ' || url || chr(10) || CASE WHEN page_id % 13 = 6 THEN '' ELSE '  Duration: 0' || CAST(page_id % 4 AS STRING) || ':1' || CAST(page_id % 10 AS STRING) || ':'
  || CAST(10 + page_id % 50 AS STRING) || '.5, start: 0.000000, bitrate: ' || CAST(100 + length(html) AS STRING) || ' kb/s' || chr(10) END
|| CASE WHEN page_id % 17 = 3 THEN '' ELSE '  Stream #0:0' || CASE WHEN page_id % 2 = 0 THEN '[0x1](und)' ELSE '' END || ': Video: ' || CASE page_id % 3 WHEN 0 THEN 'hevc (Main) (hev1 / 0x31766568)' WHEN 1 THEN 'H264 (avc1 / 0x31637661) (High)' ELSE 'vp9' END
|| ', yuv420p' || CASE WHEN page_id % 4 > 1 THEN '(tv, bt709)' ELSE '' END || ', ' || CAST(320 + page_id % 3000 AS STRING) || 'x' || CAST(240 + page_id % 2000 AS STRING) || ' [SAR 1:1 DAR 16:9], 23.97' || CAST(page_id % 10 AS STRING) || ' fps, 24k tbn' || chr(10) END
|| CASE WHEN page_id % 5 = 4 THEN '' ELSE '  Stream #0:1: Audio: aac (LC) (mp4a / 0x6134706D), ' || CAST(8000 + page_id AS STRING) || ' Hz, stereo, fltp, 128 kb/s' || chr(10) END END AS probe_text"""


@query(
    "media_metadata",
    rf"""WITH p AS (SELECT {PROBES} FROM pages), l AS (SELECT *, regexp_extract(probe_text, '(?m)^\s*Stream\s+#\d+:\d+(?:\[[^\]]+\])?(?:\([^)]+\))?:\s*Video:\s+.+$') AS v,
      regexp_extract(probe_text, '(?m)^\s*Stream\s+#\d+:\d+(?:\[[^\]]+\])?(?:\([^)]+\))?:\s*Audio:\s+.+$') AS a,
      regexp_extract(probe_text, 'Duration:\s+(\d+):(\d+):(\d+(?:\.\d+)?)', ['h', 'm', 's']) AS d FROM p),
    e AS (SELECT *, regexp_extract(v, 'Video:\s*([^,]+),.*?(\d{{2,5}})x(\d{{2,5}}).*?(\d+(?:\.\d+)?)\s+fps', ['c', 'w', 'h', 'f']) AS vm,
      list_transform(regexp_extract_all(regexp_extract(v, 'Video:(.*)$', 1), '(?:[^,(\[]|\([^)]*\)|\[[^\]]*\])+'), lambda x: trim(x)) AS vf,
      list_transform(regexp_extract_all(regexp_extract(a, 'Audio:(.*)$', 1), '(?:[^,(\[]|\([^)]*\)|\[[^\]]*\])+'), lambda x: trim(x)) AS af FROM l)
    SELECT id, CASE WHEN d.h = '' THEN 'no duration' WHEN vm.w = '' THEN 'no video stream' END AS error, CASE WHEN ok THEN TRY_CAST(vm.w AS BIGINT) END AS width, CASE WHEN ok THEN TRY_CAST(vm.h AS BIGINT) END AS height,
      CASE WHEN ok THEN TRY_CAST(d.h AS DOUBLE) * 3600 + TRY_CAST(d.m AS DOUBLE) * 60 + TRY_CAST(d.s AS DOUBLE) END AS duration_seconds, CASE WHEN ok THEN TRY_CAST(vm.f AS DOUBLE) END AS frame_rate,
      CASE WHEN ok THEN a <> '' END AS has_audio, CASE WHEN ok THEN coalesce(nullif(lower(regexp_extract(path, '\.([^.]*)$', 1)), ''), 'unknown') END AS container,
      CASE WHEN ok THEN lower(regexp_extract(vm.c, '^\s*(\S+)', 1)) END AS video_codec, CASE WHEN ok THEN TRY_CAST(regexp_extract(probe_text, 'bitrate:\s*(\d+)\s*kb/s', 1) AS BIGINT) END AS source_bitrate_kbps,
      CASE WHEN ok THEN list_filter(regexp_extract_all(vf[1], '\(([^)]+)\)', 1), lambda t: NOT contains(t, '/'))[1] END AS video_profile, CASE WHEN ok THEN vf[2] END AS pixel_format,
      CASE WHEN ok THEN nullif(lower(regexp_extract(af[1], '^\s*(\S+)', 1)), '') END AS audio_codec, CASE WHEN ok THEN list_filter(regexp_extract_all(af[1], '\(([^)]+)\)', 1), lambda t: NOT contains(t, '/'))[1] END AS audio_profile,
      CASE WHEN ok THEN TRY_CAST(regexp_extract(a, '(\d+)\s+Hz', 1) AS BIGINT) END AS audio_sample_rate, CASE WHEN ok THEN af[3] END AS audio_channels, CASE WHEN ok THEN TRY_CAST(regexp_extract(a, '(\d+)\s*kb/s', 1) AS BIGINT) END AS audio_bitrate_kbps
    FROM (SELECT *, d.h <> '' AND vm.w <> '' AS ok FROM e)""",
)
def media_metadata(spark, sf):
    good, rejected = media.extract_media_metadata(stand_in(spark, sf, "pages", PROBES))
    both = good.withColumn("error", F.lit(None).cast("string")).unionByName(
        rejected.select("id", "path", "error"), allowMissingColumns=True
    )
    whole = ("width", "height", "source_bitrate_kbps", "audio_sample_rate", "audio_bitrate_kbps")
    rest = [c for c in media.COLUMNS if c not in whole]
    return result(both, "id", "error", *[f"{c}:i" for c in whole], *rest)


@query(
    "selection_checks",
    """WITH p AS (SELECT l_orderkey AS pick_id, count(DISTINCT l_suppkey) AS n, list(l_suppkey) AS c,
      CASE WHEN l_orderkey % 5 = 0 THEN -1 ELSE min(l_suppkey) END AS winner, l_orderkey % 7 AS rating FROM lineitem GROUP BY l_orderkey)
    SELECT pick_id, array_to_string([x FOR x IN [CASE WHEN n < 2 THEN 'fewer than two candidates' END,
      CASE WHEN NOT list_contains(c, winner) THEN 'winner is not a candidate' END,
      CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating outside 1 to 5' END] IF x IS NOT NULL], '; ') AS errors FROM p""",
)
def selection_checks(spark, sf):
    order = F.col("l_orderkey")
    picks = (
        table(spark, sf, "lineitem")
        .groupBy(order.alias("pick_id"))
        .agg(F.collect_set("l_suppkey").alias("candidates"), F.min("l_suppkey").alias("_first"))
        .withColumn("winner", F.when(F.col("pick_id") % 5 == 0, F.lit(-1)).otherwise(F.col("_first")))
        .withColumn("rating", F.col("pick_id") % 7)
    )
    return requests.validate_selections(picks).select("pick_id", F.array_join("errors", "; ").alias("errors"))
