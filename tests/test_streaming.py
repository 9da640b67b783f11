"""Streams replayed from files, compared with the batch forms."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from framelane.bindings import streams
from framelane.operators import avsync, telemetry
from framelane.sources import readers
from framelane.streaming import stateful, windows


@pytest.fixture()
def replay(spark, tmp_path):
    """Run a stream over files, a few per trigger, and return all the rows it wrote.

    The file source orders by modification time, so each file gets a later one. With ``ends`` (the time column) a second run of the query sees
    the end of the stream.
    """
    counter = iter(range(1000))

    def run(build, files, schema=None, mode="append", per_trigger=2, ends=None):
        folder, out, state, end = (tmp_path / f"{n}{next(counter)}" for n in ("in", "out", "cp", "end"))
        folder.mkdir()
        for i, rows in enumerate(files):
            file = folder / f"{i:04d}.json"
            file.write_text("\n".join(json.dumps(r) for r in rows))
            os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
        if schema is None:
            source = readers.stream_progress(spark, str(folder), per_trigger)
        else:
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(str(folder))
        if ends:
            last = stateful.end_of_stream(source, ends, "")
            last.limit(0).write.parquet(str(end))
            source = source.unionByName(spark.readStream.schema(last.schema).parquet(str(end)))
        rows = build(source)
        batches = []
        for final in (False, True) if ends else (True,):
            writer = rows.writeStream.outputMode(mode).option("checkpointLocation", str(state)).trigger(availableNow=True)
            if mode == "append":
                query = writer.format("parquet").option("path", str(out)).start()
            else:
                query = writer.foreachBatch(lambda batch, _: batches.extend(batch.collect())).start()
            try:
                query.awaitTermination(60)
                assert query.exception() is None and not query.isActive
                run.dropped = stateful.dropped_rows(query)
                held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
                run.most_state = max([0, *held]) if not final or not ends else run.most_state
                run.batches = sum(p["numInputRows"] > 0 for p in query.recentProgress) if not final or not ends else run.batches
            finally:
                query.stop()
            if not final:
                last.write.mode("append").parquet(str(end))
        return spark.read.schema(rows.schema).parquet(str(out)).collect() if mode == "append" else batches

    stateful.use_rocksdb(spark)
    return run


def snapshot(second, frames, job="j", phase="upscaling", **more):
    minute, rest = divmod(second, 60)
    whole, part = int(rest), rest - int(rest)
    ts = f"2024-01-01T00:{int(minute):02d}:{whole:02d}.{int(round(part * 1000)):03d}Z"
    return {"jobId": job, "ts": ts, "phase": phase, "percent": 1, "message": "m", "processedFrames": frames, "totalFrames": 100, **more}


def test_throughput(replay):
    files = [[snapshot(0, 0)], [snapshot(10, 50, processRssBytes=9)], [snapshot(10.5, 60)], [snapshot(12, 70, processRssBytes=4)]]
    got = {r.seconds % 60: r for r in replay(lambda s: stateful.stream_throughput(s, ttl_seconds=None), files, per_trigger=1, ends="ts")}
    last = got[12]
    assert last.average_fps == pytest.approx(70 / 12)
    assert last.rolling_fps == pytest.approx(10.0)  # since second 10; second 10.5 was too close
    assert last.remaining_seconds == pytest.approx(30 / (70 / 12))
    assert got[10.5].rolling_fps == pytest.approx(5.0) and last.peak_rss_bytes == 9


def test_dedupe_progress(replay):
    files = [[snapshot(0, 1)], [snapshot(1, 1)], [snapshot(2, 2)], [snapshot(3, 2)], [snapshot(8, 2)], [snapshot(1, 7, job="k")]]
    got = replay(lambda s: stateful.stream_dedupe_progress(s, ttl_seconds=None), files, per_trigger=1, ends="ts")
    assert sorted((r.job_id, r.ts.second) for r in got) == [("j", 0), ("j", 2), ("j", 8), ("k", 1)]


def test_gate(replay):
    files = [[snapshot(0, 1, phase="extracting")], [snapshot(1, 2, phase="extracting", encodedFrames=3)], [snapshot(2, 3)]]
    assert sorted(r.ts.second for r in replay(telemetry.gate_extracting, files)) == [0, 2]


def test_job_state(replay):
    schema = "job_id string, ts timestamp, state string"
    moves = ["queued", "running", "paused", "running", "succeeded", "running"]
    files = [[{"job_id": "j", "ts": f"2024-01-01T00:00:0{i}Z", "state": s}] for i, s in enumerate(moves)]
    got = sorted(replay(lambda s: stateful.stream_job_state(s, ttl_seconds=None), files, schema, per_trigger=2, ends="ts"), key=lambda r: r.seconds)
    assert [(r.state, r.valid) for r in got] == [
        ("queued", True), ("running", True), ("paused", True), ("running", True), ("succeeded", True), ("running", False),
    ]
    assert got[-1].error == "succeeded cannot become running"


def test_gpu_activity_matches_batch(spark, replay):
    schema = "run_id string, sample_seq bigint, utilization_percent bigint, memory_used_bytes bigint"
    rows = [("a", i, [0, 3, None, 40][i % 4], 100 * 2**20 + i * 2**22) for i in range(30)]
    rows += [("idle", i, 0, 7) for i in range(3)] + [("none", 0, None, None)]
    names = [c.split(" ")[0] for c in schema.split(", ")]
    files = [[dict(zip(names, r)) for r in reversed(rows[i : i + 7])] for i in range(0, len(rows), 7)]
    streamed = {}
    for r in replay(windows.stream_gpu_activity, files, schema, mode="update"):
        streamed[r.run_id] = r if r.run_id not in streamed or r.sample_count >= streamed[r.run_id].sample_count else streamed[r.run_id]
    batch = {r.run_id: r for r in telemetry.assess_gpu_activity(spark.createDataFrame(rows, schema)).collect()}
    assert {k: tuple(v) for k, v in streamed.items()} == {k: tuple(v) for k, v in batch.items()}
    assert batch["idle"].warning and not batch["idle"].activity_detected and batch["idle"].memory_delta_bytes == 0
    assert batch["none"].warning is None and batch["none"].sample_count == 0


def test_edges_match_batch(spark, replay):
    schema = "media_id string, frame_index bigint, mean_luma double"
    rows = [("m", i, 200.0 if i % 7 in (2, 3) else 10.0) for i in range(40)]
    timed = schema + ", ts timestamp"
    files = [
        [dict(media_id=m, frame_index=i, mean_luma=v, ts=f"2024-01-01T00:00:{i:02d}Z") for m, i, v in rows[k : k + 10]] for k in (30, 0, 20, 10)
    ]
    streamed = {r.position for r in replay(lambda s: stateful.stream_edges(s, 100.0, ttl_seconds=None, ts="ts"), files, timed, per_trigger=1, ends="ts")}
    assert run_batches(replay) == 4
    batch = {r.frame_index for r in telemetry.rising_edges(spark.createDataFrame(rows, schema), 100.0).collect()}
    assert streamed == batch == {i for i in range(40) if i % 7 == 2}


def run_batches(replay):
    return replay.batches


def test_any_number_of_batches_gives_the_same_rows(replay):
    """The same rows in one trigger, and shuffled over five files of one trigger each."""
    rng = random.Random(3)
    phases = ["queued", "running", "running", "paused", "running", "succeeded"]
    schema = "job_id string, ts timestamp, phase string, processed_frames bigint, total_frames bigint, process_rss_bytes bigint, gpu_memory_used_bytes bigint"
    rows = [
        dict(job_id=f"j{s % 3}", ts=f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z", phase=rng.choice(phases), processed_frames=s * 3 % 50, total_frames=100)
        for s in range(0, 240, 2)
    ]
    mixed = rng.sample(rows, len(rows))
    operators = [
        lambda s: stateful.stream_throughput(s, ttl_seconds=None),
        lambda s: stateful.stream_dedupe_progress(s, ("phase",), heartbeat=10.0, ttl_seconds=None),
        lambda s: stateful.stream_job_state(s.withColumn("state", s["phase"]), ttl_seconds=None),
        lambda s: stateful.stream_edges(
            s.selectExpr("job_id AS media_id", "unix_seconds(ts) AS frame_index", "processed_frames AS mean_luma", "ts"), 25.0, ttl_seconds=None, ts="ts"
        ),
    ]
    for build in operators:
        whole = replay(build, [rows], schema, per_trigger=1, ends="ts")
        cut = replay(build, [mixed[i::5] for i in range(5)], schema, per_trigger=1, ends="ts")
        assert replay.batches == 5 and replay.dropped == 0
        assert len(whole) > 5 and sorted(map(str, whole)) == sorted(map(str, cut))


def test_too_late_rows_are_counted(replay):
    files = [[snapshot(0, 0)], [snapshot(3000, 50)], [snapshot(3001, 51)], [snapshot(1, 1)]]
    got = replay(lambda s: stateful.stream_throughput(s, ttl_seconds=None, late="1 minute"), files, per_trigger=1)
    assert replay.dropped == 1 and all(r.processed_frames != 1 for r in got)


def test_windows_and_sessions(replay):
    schema = "job_id string, ts timestamp, rolling_fps double, gpu_memory_used_bytes bigint"

    def sample(second, job="j"):
        return {"job_id": job, "ts": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z", "rolling_fps": float(second), "gpu_memory_used_bytes": second}

    files = [[sample(s)] for s in (5, 20, 70, 100, 900, 1800)]
    tumbling = replay(lambda s: windows.stream_windows(s, "1 minute", late="10 seconds"), files, schema, per_trigger=1)
    got = {r.window_start % 3600: (r.samples, r.average_fps, r.peak_memory) for r in tumbling}
    assert got[0] == (2, 12.5, 20) and got[60] == (2, 85.0, 100)
    sessions = replay(lambda s: windows.stream_sessions(s, "5 minutes", "10 seconds"), files, schema, per_trigger=1)
    first = min(sessions, key=lambda r: r.session_start)
    assert (first.samples, first.average_fps) == (4, 48.75)


def test_dedupe_import(replay):
    schema = "library_id string, created_at timestamp, content string, file_name string"
    def f(i, content, library="l"):
        return {"library_id": library, "created_at": f"2024-01-01T00:00:{i:02d}Z", "content": content, "file_name": f"f{i}"}

    files = [[f(0, "a")], [f(1, "a")], [f(2, "b"), f(3, "a", "k")]]
    got = replay(windows.stream_dedupe_import, files, schema, per_trigger=1)
    assert sorted((r.library_id, r.content) for r in got) == [("k", "a"), ("l", "a"), ("l", "b")]


def test_gpu_lines_from_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"run_id": "r", "sample_seq": 1, "line": "81, 10240, 98304"}\n{"run_id": "r", "sample_seq": 1, "line": "oops"}\n')
    stream = readers.stream_gpu_samples(spark, str(tmp_path))
    assert stream.isStreaming
    batch = spark.read.schema(stream.schema).json(str(tmp_path))
    got = telemetry.parse_gpu_samples(batch).first()
    assert (got.utilization_percent, got.memory_used_bytes, got.memory_total_bytes) == (81, 10240 * 2**20, 98304 * 2**20)


@pytest.mark.parametrize("rows_of_range", [15, 10**6])
def test_a_replayed_table_drains_in_ranges(spark, tmp_path, monkeypatch, rows_of_range):
    """A key with a third of the rows, in files of any order and with equal times: each write of a key stays within a range."""
    monkeypatch.setattr(streams, "RANGE_ROWS_PER_CORE", rows_of_range)
    rng = random.Random(8)
    states = ("signup", "click", "purchase", "view")
    rows = [(0 if i % 3 == 0 else i % 40, f"2024-01-{1 + i // 40:02d} 00:{i % 40:02d}:00.{i % 7:06d}", rng.choice(states)) for i in range(900)]
    rows += [(0, rows[5][1], "click"), (1, rows[5][1], "click")]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "user_id long, ts string, event_type string")
    frame.selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    got = streams.stream_job_state(spark, str(tmp_path))
    written = got.select("job_id", F.input_file_name().alias("file")).where("job_id = '0'").groupBy("file").count().collect()
    names = {"signup": "queued", "click": "paused", "purchase": "succeeded"}
    want, held = [], {}
    for user, ts, state in sorted((str(u), t, names.get(s, "running")) for u, t, s in rows):
        before = held.get(user)
        if before != state:
            valid = before is None or state in stateful.MOVES.get(before, ())
            want.append((user, state, before, valid))
            held[user] = state if valid else before
    assert sorted(map(str, ((r.job_id, r.state, r.previous, r.valid) for r in got.collect()))) == sorted(map(str, want))
    assert (len(written) > 3 and max(r["count"] for r in written) < 80) if rows_of_range == 15 else len(written) == 1


DEVICE_LINES = "run_id STRING, sample_seq BIGINT, ts TIMESTAMP, line STRING"


def device_lines(rng, gap_after=None):
    """Lines of three devices per sample; run r2 pauses after a sample, if told so."""
    rows = []
    for run in ("r1", "r2", "r3"):
        for seq in range(30):
            at = seq + (600 if run == "r2" and gap_after is not None and seq > gap_after else 0)
            for device in range(3):
                line = rng.choice([f"{rng.randrange(0, 9)}, {rng.randrange(500, 900)}, 8000", "bad, 1, 2", f"{rng.randrange(99)}, none, 8000"])
                rows.append({"run_id": run, "sample_seq": seq, "ts": f"2024-01-01T01:{at // 60:02d}:{at % 60:02d}.000Z", "line": line})
    return rows


@pytest.mark.parametrize("per_file", [7, 1000])
def test_gpu_runs_sum_devices_and_end(spark, replay, per_file):
    """Two stateful operators in one stream, with finite lateness, against the batch form; however the lines are cut into batches."""
    lines = device_lines(random.Random(per_file))
    lines.sort(key=lambda r: (r["ts"], r["line"]))
    for i in range(0, len(lines) - 6, 6):  # out of order within a few samples
        lines[i : i + 6] = reversed(lines[i : i + 6])
    files = [lines[i : i + per_file] for i in range(0, len(lines), per_file)]
    got = {r.run_id: r for r in replay(lambda s: windows.stream_gpu_runs(s, gap="1 minute", late="10 seconds"), files, DEVICE_LINES, per_trigger=4, ends="ts") if r.run_id}
    assert replay.dropped == 0
    batch = spark.createDataFrame([(r["run_id"], r["sample_seq"], r["line"]) for r in lines], "run_id string, sample_seq long, line string")
    want = telemetry.assess_gpu_activity(telemetry.parse_gpu_samples(batch)).collect()
    assert len(want) == 3 and {r.run_id: r.asDict() for r in want} == {k: {c: r[c] for c in want[0].asDict()} for k, r in got.items()}


def test_gpu_runs_part_at_a_gap(replay):
    lines = sorted(device_lines(random.Random(5), gap_after=11), key=lambda r: r["ts"])
    rows = [r for r in replay(lambda s: windows.stream_gpu_runs(s, gap="1 minute", late="10 seconds"), [lines], DEVICE_LINES, ends="ts") if r.run_id]
    assert sorted((r.run_id, (r.ended - r.started).total_seconds()) for r in rows) == [("r1", 30.0), ("r2", 12.0), ("r2", 18.0), ("r3", 30.0)]


def test_aligned_events_stream(spark, replay):
    """Sparse events: the rows of the batch alignment, and expected events without partners; state goes with the watermark."""
    rows, files = [], []
    for media in ("a", "b"):
        for k in range(40):
            at = 100 + 10 * k
            for stream, shift in (("expected", 0), ("video", 12 * k % 90), ("audio", 30 - k)):
                rows.append((media, stream, at + shift / 1000))
    stamp = lambda s: f"2024-01-01T00:{int(s) // 60:02d}:{s % 60:06.3f}Z"
    feed = sorted(rows + [("c", "expected", 150.0), ("c", "video", 152.5), ("c", "expected", 160.0), ("c", "audio", 160.5)], key=lambda r: r[2])
    files = [[{"media_id": m, "stream": s, "ts": stamp(t)} for m, s, t in feed[i : i + 20]] for i in range(0, len(feed), 20)]
    schema = "media_id STRING, stream STRING, ts TIMESTAMP"
    got = [r for r in replay(lambda s: windows.stream_align_events(s, reach="1 second", late="5 seconds"), files, schema, per_trigger=1, ends="ts") if r.media_id]
    lonely = {(r.expected_seconds % 3600, r.video_offset_ms, r.audio_offset_ms) for r in got if r.media_id == "c"}
    assert lonely == {(150.0, None, None), (160.0, None, 500.0)}
    batch = avsync.align_events(spark.createDataFrame(rows, "media_id string, stream string, seconds double")).collect()
    offsets = lambda rs: sorted((r.media_id, *(round(v, 2) for v in (r.video_offset_ms, r.audio_offset_ms, r.av_offset_ms))) for r in rs)
    assert offsets(r for r in got if r.media_id != "c") == offsets(batch)
    assert 0 < replay.most_state < len(feed) / 2


def test_a_gap_of_just_the_given_length_parts_runs(replay):
    """Samples 19 seconds apart are one run, 20 seconds apart two."""
    schema = "run_id STRING, sample_seq BIGINT, ts TIMESTAMP, line STRING"
    rows = [{"run_id": "r", "sample_seq": s, "ts": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}.000Z", "line": "9, 10, 20"} for s in (0, 19, 39, 58)]
    got = replay(lambda s: windows.stream_gpu_runs(s, gap="20 seconds", late="1 second"), [rows], schema, ends="ts")
    assert sorted(r.sample_count for r in got if r.run_id) == [2, 2]


def test_a_run_without_memory_has_a_delta_of_zero(spark):
    samples = spark.createDataFrame([("r", 0, None, None)], "run_id string, sample_seq long, utilization_percent long, memory_used_bytes long")
    got = telemetry.assess_gpu_activity(samples).first()
    assert (got.memory_delta_bytes, got.activity_detected, got.first_memory_bytes) == (0, False, None)


def test_keys_of_one_bucket_keep_their_own_state(replay, monkeypatch):
    """Many keys in few buckets: what is held and its lifetime are each key's; the store has a few values, not one per row and key."""
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    schema = "job_id string, ts timestamp, state string"
    files = [
        [{"job_id": f"j{j}", "ts": f"2024-01-01T00:{i:02d}:{j:02d}Z", "state": s} for j in range(40)] for i, s in enumerate(("queued", "running", "succeeded"))
    ]
    got = replay(lambda s: stateful.stream_job_state(s, ttl_seconds=None), files, schema, per_trigger=1, ends="ts")
    assert sorted((r.job_id, r.state, r.previous) for r in got) == sorted(
        (f"j{j}", s, p) for j in range(40) for s, p in (("queued", None), ("running", "queued"), ("succeeded", "running"))
    )
    assert replay.dropped == 0 and 0 < replay.most_state < 40


def test_commits_write_changes_only(spark):
    stateful.use_rocksdb(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled") == "true"
