"""Streaming queries: a given table is replayed as a file stream until it is used up, into a table in the shared folder."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import functions as F, types as T

from framelane.bindings.registry import query, result, split_columns, table
from framelane.bindings.runs import GATE, LINES, PROGRESS, PROGRESS_SQL, SAMPLE_SQL
from framelane.operators import ordered, telemetry
from framelane.session import ensure_checkpoint_dir
from framelane.sources import snapshots
from framelane.streaming import stateful, windows


@contextlib.contextmanager
def state_partitions(spark):
    """A state partition for each core: every one costs a Python worker and a store in every micro-batch, however few rows it has."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, max(1, min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def replay(spark, sf_dir, name, columns, build, mode="append", ts=None, key=None):
    """Stream ``columns`` of a table through ``build`` and read back what it wrote.

    With ``ts`` and ``key`` the operator holds rows until the watermark passes them: once the table is used up, a second run of the query
    sees one row at the end of time. A dropped row is an error, since a replay must be complete. In update mode the newest row of each
    ``key`` counts.
    """
    stateful.use_rocksdb(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = (
        spark.readStream.schema(table(spark, sf_dir, name).schema)
        .option("maxBytesPerTrigger", 256 * 2**20)
        .parquet(f"{sf_dir}/{name}.parque[t]")  # as a pattern, the table may be one file or a folder of files
        .select(*[F.expr(c) for c in split_columns(columns)])
    )
    ends = mode == "append" and ts is not None
    if ends:
        end = stateful.end_of_stream(source, ts, key)
        end.limit(0).write.parquet(f"{folder}/end")
        source = source.unionByName(spark.readStream.schema(end.schema).parquet(f"{folder}/end"))
    rows = build(source)
    target = f"{folder}/rows"
    for last in (False, True) if ends else (True,):
        writer = rows.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode(mode)
        if mode == "update":
            writer = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch={n}"))
        else:
            writer = writer.format("parquet").option("path", target)
        with state_partitions(spark):
            running = writer.start()
            running.awaitTermination()
        if stateful.dropped_rows(running):
            raise RuntimeError("rows were dropped as too late")
        if not last:
            end.write.mode("append").parquet(f"{folder}/end")
    if mode != "update":
        return spark.read.schema(rows.schema).parquet(target)
    found = spark.read.parquet(target)
    newest = found.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("r"))
    return newest.select("r.*")


#: Rows of a range of event time for each core of the cluster, about. A key has at most a range in state at once.
RANGE_ROWS_PER_CORE = 150_000


def replay_in_order(spark, sf_dir, name, columns, build, ts, key, where="true"):
    """Stream ``columns`` of a table through ``build`` in order of the time ``ts`` and read back what it wrote.

    The table is cut at quantiles of its times into ranges of some ``RANGE_ROWS_PER_CORE`` rows a core (rows of one instant stay together),
    staged as one folder each, so a run has as much work for each core however large the cluster is. Each range is one run and one micro-batch of the query, and after it the watermark passes its last row; so the
    operator, with no lateness, holds a range of a key's rows and not its history. The last run sees the end of the stream. A dropped row is an
    error, since a replay must be complete. Rows that are not ``where`` are of no use to the operator and not staged. The driver sees one time
    per range.
    """
    stateful.use_rocksdb(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, name).select(*[F.expr(c) for c in split_columns(columns)]).where(where)
    schema, micros = rows.schema, F.unix_micros(F.col(ts).cast("timestamp"))
    parts = max(1, -(-rows.count() // (RANGE_ROWS_PER_CORE * spark.sparkContext.defaultParallelism)))
    shares = [k / parts for k in range(1, parts)]
    edges = []
    if shares:
        found = rows.agg(F.percentile_approx(micros, shares, max(10_000, 10 * parts)).alias("at")).first()["at"]
        edges = sorted(set(found or []))
    place = ordered._bisect(micros, F.array(*[F.lit(e) for e in edges]), len(edges).bit_length()) if edges else F.lit(0)
    rows.withColumn("_range", place).repartitionByRange(ts).write.partitionBy("_range").parquet(f"{folder}/staged")
    staged = spark.read.schema(T.StructType([*schema.fields, T.StructField("_range", T.IntegerType())])).parquet(f"{folder}/staged")
    slices = [staged.where(F.col("_range") == k).drop("_range") for k in range(len(edges) + 1)]
    slices.append(stateful.end_of_stream(rows, ts, key))
    slices[-1].limit(0).write.parquet(f"{folder}/in")
    built, target = build(spark.readStream.schema(schema).parquet(f"{folder}/in")), f"{folder}/rows"
    for part in slices:
        part.write.mode("append").parquet(f"{folder}/in")
        writer = built.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append")
        with state_partitions(spark):
            running = writer.format("parquet").option("path", target).start()
            running.awaitTermination()
        if stateful.dropped_rows(running):
            raise RuntimeError("rows were dropped as too late")
    return spark.read.schema(built.schema).parquet(target)


#: Range after range, no row comes late.
IN_ORDER = "0 seconds"
STREAM_PROGRESS = PROGRESS.replace("event_id, ts,", "event_id, CAST(ts AS TIMESTAMP) AS ts,")


@query(
    "stream_throughput",
    f"""WITH RECURSIVE {PROGRESS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, processed_frames) AS n FROM pr),
    k AS (SELECT job_id, n, s AS t, processed_frames AS f, NULL::DOUBLE AS rate FROM o WHERE n = 1
      UNION ALL SELECT k.job_id, o.n, CASE WHEN o.s - k.t >= 1 THEN o.s ELSE k.t END, CASE WHEN o.s - k.t >= 1 THEN o.processed_frames ELSE k.f END,
        CASE WHEN o.s - k.t >= 1 THEN greatest(0, o.processed_frames - k.f) / (o.s - k.t) ELSE k.rate END FROM k JOIN o ON o.job_id = k.job_id AND o.n = k.n + 1),
    l AS (SELECT *, s - min(s) OVER (PARTITION BY job_id) AS el,
      max(process_rss_bytes) OVER w AS rss, max(gpu_memory_used_bytes) OVER w AS gpu FROM o WINDOW w AS (PARTITION BY job_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT *, CASE WHEN el > 0 AND processed_frames > 0 THEN processed_frames / el END AS av FROM l)
    SELECT CAST(a.job_id AS VARCHAR) AS job_id, round(s, 3) AS seconds, processed_frames, round(av, 6) AS average_fps, round(rate, 6) AS rolling_fps,
      round(CASE WHEN total_frames > processed_frames THEN (total_frames - processed_frames) / av END, 3) AS remaining_seconds,
      CAST(rss AS BIGINT) AS peak_rss_bytes, CAST(gpu AS BIGINT) AS peak_gpu_bytes FROM a JOIN k USING (job_id, n)""",
)
def stream_throughput(spark, sf):
    out = replay_in_order(
        spark, sf, "events", STREAM_PROGRESS,
        lambda s: stateful.stream_throughput(s, ttl_seconds=None, late=IN_ORDER), ts="ts", key="job_id",
    )
    return result(
        out, "job_id", "seconds:d3", "processed_frames:i", "average_fps:d", "rolling_fps:d", "remaining_seconds:d3", "peak_rss_bytes:i", "peak_gpu_bytes:i"
    )


@query(
    "stream_deduped_progress",
    f"""WITH RECURSIVE {PROGRESS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n FROM pr),
    k AS (SELECT job_id, n, event_id, phase, percent, message, s AS t, TRUE AS kept FROM o WHERE n = 1
      UNION ALL SELECT k.job_id, o.n, o.event_id, CASE WHEN new THEN o.phase ELSE k.phase END, CASE WHEN new THEN o.percent ELSE k.percent END,
        CASE WHEN new THEN o.message ELSE k.message END, CASE WHEN new THEN o.s ELSE k.t END, new
        FROM k JOIN o ON o.job_id = k.job_id AND o.n = k.n + 1,
        LATERAL (SELECT (k.phase, k.percent, k.message) IS DISTINCT FROM (o.phase, o.percent, o.message) OR o.s - k.t >= 21600 AS new))
    SELECT job_id, event_id, phase, percent FROM k WHERE kept""",
)
def stream_deduped_progress(spark, sf):
    signature = ("phase", "percent", "message")
    out = replay_in_order(
        spark, sf, "events", STREAM_PROGRESS,
        lambda s: stateful.stream_dedupe_progress(s, signature, heartbeat=21_600.0, ttl_seconds=None, late=IN_ORDER, tie="event_id"), ts="ts", key="job_id",
    )
    return out.select("job_id", "event_id", "phase", "percent")


@query(
    "stream_gated_progress",
    f"""WITH g AS (SELECT {GATE} FROM events) SELECT event_id, phase FROM g
    WHERE phase <> 'extracting' OR NOT (upscaled_frames > 0 OR interpolated_frames > 0 OR coalesce(encoded_frames, 0) > 0)""",
)
def stream_gated_progress(spark, sf):
    return replay(spark, sf, "events", GATE, telemetry.gate_extracting).select("event_id", "phase")


@query(
    "stream_gpu_activity",
    f"""WITH li AS (SELECT {LINES}, event_id FROM events), u AS (SELECT run_id, event_id, p, CASE WHEN len(p) >= 3 THEN floor(TRY_CAST(trim(p[1]) AS DOUBLE)) END AS ut
      FROM (SELECT *, string_split(trim(line), ',') AS p FROM li)),
    m AS (SELECT run_id, event_id, ut, CASE WHEN ut IS NOT NULL THEN floor(TRY_CAST(trim(p[2]) AS DOUBLE)) * 1048576 END AS mem FROM u),
    g AS (SELECT run_id, count(ut) AS n, count(*) FILTER (WHERE ut >= 5) AS a, max(ut) AS mu,
      arg_min(mem, event_id) FILTER (WHERE mem IS NOT NULL) AS f, max(mem) AS pk FROM m GROUP BY 1),
    d AS (SELECT *, greatest(0, pk - f) AS delta FROM g)
    SELECT run_id, CAST(n AS BIGINT) AS sample_count, CAST(a AS BIGINT) AS active_sample_count, CAST(mu AS BIGINT) AS max_utilization_percent,
      CAST(f AS BIGINT) AS first_memory_bytes, CAST(pk AS BIGINT) AS peak_memory_bytes, CAST(delta AS BIGINT) AS memory_delta_bytes,
      coalesce(mu >= 5, FALSE) OR coalesce(delta >= 268435456, FALSE) AS activity_detected FROM d""",
)
def stream_gpu_activity(spark, sf):
    def build(lines):
        # every line is a sample of its own here: summing the devices of a sample would be a second aggregation
        parts = F.split(F.trim("line"), ",", 3)
        value = F.when(F.size(parts) == 3, F.floor(F.trim(F.get(parts, 0)).try_cast("double"))).cast("bigint")
        used = F.floor(F.trim(F.get(parts, 1)).try_cast("double")).cast("bigint") * telemetry.MIB
        samples = lines.select("run_id", "event_id", value.alias("utilization_percent"), used.alias("memory_used_bytes"))
        return windows.stream_gpu_activity(samples, order="event_id")

    out = replay(spark, sf, "events", LINES + ", event_id", build, mode="update", key="run_id")
    counts = ("sample_count", "active_sample_count", "max_utilization_percent", "first_memory_bytes", "peak_memory_bytes", "memory_delta_bytes")
    return result(out, "run_id", *[f"{c}:i" for c in counts], "activity_detected")


STATES = """CAST(user_id AS STRING) AS job_id, {ts} AS ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'paused'
WHEN 'purchase' THEN 'succeeded' ELSE 'running' END AS state"""


@query(
    "stream_job_state",
    f"""WITH RECURSIVE c AS (SELECT {STATES.format(ts='ts')} FROM events), e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, state) AS n FROM c),
    r AS (SELECT job_id, n, ts, state, NULL::VARCHAR AS previous, TRUE AS valid, state AS cur FROM e WHERE n = 1
      UNION ALL SELECT e.job_id, e.n, e.ts, e.state, r.cur, ok, CASE WHEN ok THEN e.state ELSE r.cur END FROM r JOIN e ON e.job_id = r.job_id AND e.n = r.n + 1,
        LATERAL (SELECT (r.cur = 'queued' AND e.state <> 'queued') OR (r.cur = 'running' AND e.state IN ('paused', 'succeeded')) OR (r.cur = 'paused' AND e.state IN ('running', 'succeeded')) AS ok))
    SELECT job_id, round(epoch_us(ts) / 1000000.0::DOUBLE, 3) AS seconds, state, previous, valid FROM r WHERE previous IS NULL OR previous <> state""",
)
def stream_job_state(spark, sf):
    out = replay_in_order(
        spark, sf, "events", STATES.format(ts="CAST(ts AS TIMESTAMP)"),
        lambda s: stateful.stream_job_state(s, ttl_seconds=None, late=IN_ORDER), ts="ts", key="job_id",
    )
    return result(out, "job_id", "seconds:d3", "state", "previous", "valid")


@query(
    "stream_edges",
    """WITH l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
    SELECT CAST(user_id AS VARCHAR) AS media_id, event_id AS position, round(value, 6) AS value FROM l WHERE value >= 30 AND coalesce(p < 30, TRUE)""",
)
def stream_edges(spark, sf):
    out = replay_in_order(
        spark, sf, "events", "user_id AS media_id, event_id AS frame_index, value AS mean_luma, timestamp_seconds(1700000000 + event_id) AS ts",
        lambda s: stateful.stream_edges(s, 30.0, ttl_seconds=None, late=IN_ORDER, ts="ts"), ts="ts", key="media_id",
    )
    return result(out, "media_id", "position:i", "value:d")


@query(
    "stream_windows",
    f"""WITH {PROGRESS_SQL} SELECT job_id, CAST(floor(s / 21600) * 21600 AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS samples,
    round(avg(processed_frames), 6) AS average_fps, CAST(max(gpu_memory_used_bytes) AS BIGINT) AS peak_memory FROM pr GROUP BY ALL""",
)
def stream_windows(spark, sf):
    out = replay_in_order(
        spark, sf, "events", STREAM_PROGRESS,
        lambda s: windows.stream_windows(s, "6 hours", late=IN_ORDER, fps="processed_frames"), ts="ts", key="job_id",
    ).where("job_id IS NOT NULL")  # the end of the stream
    return result(out, "job_id", "window_start:i", "samples:i", "average_fps:d", "peak_memory:i")


@query(
    "stream_dedupe_import",
    "SELECT DISTINCT source AS library_id, sha256(text) AS content_hash FROM documents",
)
def stream_dedupe_import(spark, sf):
    out = replay(
        spark, sf, "documents", "source AS library_id, text AS content, timestamp_seconds(1700000000 + doc_id) AS created_at",
        lambda s: windows.stream_dedupe_import(s, late="3650 days").select("library_id", "content_hash"),
    )
    return out


@query(
    "stream_snapshots",
    "SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, event_type AS phase, round(value, 6) AS value, CAST(1 AS BIGINT) AS times_read FROM events",
)
def stream_snapshots(spark, sf):
    """The events as snapshot files that arrive in two lots; the stream is started anew from its offsets after each, and once more."""
    folder = f"{ensure_checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").selectExpr("event_id", "CAST(user_id AS STRING) AS job_id", "event_type AS phase", "value")
    early = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    fields, rows = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema), None
    for lot in (events.where(early), events.where(~early), None):
        if lot is not None:
            lot.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(f"{folder}/in")
        rows = snapshots.stream_snapshots(spark, f"{folder}/in", fields, lines="true", settle_seconds="0")
        running = rows.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/rows")
        running.awaitTermination()
    read = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    counted = read.groupBy("event_id", "job_id", "phase", "value").agg(F.count(F.lit(1)).alias("times_read"))
    return result(counted, "event_id:i", "job_id", "phase", "value:d", "times_read:i")


@query(
    "stream_gpu_runs",
    f"""WITH {SAMPLE_SQL}, ses AS (SELECT *, sum(CASE WHEN gap >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY sample_seq) AS k FROM (
      SELECT *, sample_seq - lag(sample_seq) OVER (PARTITION BY run_id ORDER BY sample_seq) AS gap FROM gs)),
    g AS (SELECT run_id, k, min(sample_seq) AS first_sample, count(utilization_percent) AS n, count(*) FILTER (WHERE utilization_percent >= 5) AS a,
      max(utilization_percent) AS mu, arg_min(memory_used_bytes, sample_seq) FILTER (WHERE utilization_percent IS NOT NULL AND memory_used_bytes IS NOT NULL) AS f,
      max(memory_used_bytes) FILTER (WHERE utilization_percent IS NOT NULL) AS pk FROM ses GROUP BY 1, 2),
    d AS (SELECT *, greatest(0, pk - f) AS delta FROM g)
    SELECT run_id, CAST(first_sample AS BIGINT) AS first_sample, CAST(n AS BIGINT) AS sample_count, CAST(a AS BIGINT) AS active_sample_count,
      CAST(mu AS BIGINT) AS max_utilization_percent, CAST(f AS BIGINT) AS first_memory_bytes, CAST(pk AS BIGINT) AS peak_memory_bytes,
      CAST(delta AS BIGINT) AS memory_delta_bytes, coalesce(mu >= 5, FALSE) OR coalesce(delta >= 268435456, FALSE) AS activity_detected FROM d""",
)
def stream_gpu_runs(spark, sf):
    """The lines of a sample are its devices; a run ends when it has had no sample for 20 seconds. Sample n has the time n."""
    lines = LINES + ", timestamp_seconds(1700000000 + floor(event_id / 300)) AS ts"
    out = replay_in_order(spark, sf, "events", lines, lambda s: windows.stream_gpu_runs(s, gap="20 seconds", late=IN_ORDER), ts="ts", key="run_id")
    out = out.where("run_id IS NOT NULL").withColumn("first_sample", F.unix_seconds("started") - 1_700_000_000)
    counts = ("first_sample", "sample_count", "active_sample_count", "max_utilization_percent", "first_memory_bytes", "peak_memory_bytes", "memory_delta_bytes")
    return result(out, "run_id", *[f"{c}:i" for c in counts], "activity_detected")


AV_EVENTS = """CAST(user_id AS STRING) AS media_id, CAST(ts AS TIMESTAMP) AS ts,
CASE event_type WHEN 'view' THEN 'expected' WHEN 'click' THEN 'video' WHEN 'purchase' THEN 'audio' END AS stream"""


@query(
    "stream_aligned_events",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS media_id, epoch_us(ts) AS t, event_type FROM events),
    x AS (SELECT media_id, t FROM e WHERE event_type = 'view'), v AS (SELECT media_id, t FROM e WHERE event_type = 'click'), a AS (SELECT media_id, t FROM e WHERE event_type = 'purchase')
    SELECT x.media_id, round(x.t / 1000000.0::DOUBLE, 3) AS expected_seconds, round((v.t - x.t) / 1000.0::DOUBLE, 3) AS video_offset_ms,
      round((a.t - x.t) / 1000.0::DOUBLE, 3) AS audio_offset_ms, round((a.t - v.t) / 1000.0::DOUBLE, 3) AS av_offset_ms
    FROM x LEFT JOIN v ON v.media_id = x.media_id AND abs(v.t - x.t) <= 7200000000 LEFT JOIN a ON a.media_id = x.media_id AND abs(a.t - x.t) <= 7200000000""",
)
def stream_aligned_events(spark, sf):
    out = replay_in_order(
        spark, sf, "events", AV_EVENTS,
        lambda s: windows.stream_align_events(s, reach="2 hours", late=IN_ORDER), ts="ts", key="media_id", where="stream IS NOT NULL",
    )
    out = out.where("media_id IS NOT NULL")
    return result(out, "media_id", "expected_seconds:d3", "video_offset_ms:d3", "audio_offset_ms:d3", "av_offset_ms:d3")
