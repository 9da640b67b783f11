"""The segment store: commits, refusals, failures half-way, retries."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framelane.operators.completeness import remaining_segments
from framelane.sources import segments

SCHEMA = "source_id string, segment_index long, frame_index long, planned_frames long, seams_ok boolean, pixels string"


@pytest.fixture()
def store(tmp_path):
    return str(tmp_path / "store")


def frames(spark, spec):
    """spec: (source, segment) -> (frames, planned, seams_ok, pixels)."""
    rows = [(s, k, k * 100 + i, planned, ok, pixels) for (s, k), (n, planned, ok, pixels) in spec.items() for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def content(spark, store):
    return Counter((r.source_id, r.segment_index, r.pixels) for r in segments.read_segments(spark, store, SCHEMA).collect())


def files(store, folder):
    path = f"{store}/{folder}"
    return sorted(f for f in os.listdir(path) if not f.startswith(".")) if os.path.isdir(path) else []


def test_promotion_needs_count_and_seams(spark, store):
    spec = {("a", 0): (5, 5, True, "v1"), ("a", 1): (4, 5, True, "v1"), ("b", 0): (3, 3, False, "v1"), ("b", 1): (3, None, None, "v1")}
    segments.commit_segments(frames(spark, spec), store)
    assert content(spark, store) == {("a", 0, "v1"): 5, ("b", 1, "v1"): 3}
    ledger = segments.read_ledger(spark, store)
    assert {(r.source_id, r.segment_index): r.reason for r in ledger.collect()} == {("a", 0): None, ("a", 1): "frame count", ("b", 0): "seams", ("b", 1): None}
    plans = spark.createDataFrame([(s, k) for s in "ab" for k in range(3)], "source_id string, segment_index long")
    left = remaining_segments(plans, segments.current_segments(ledger))
    assert {tuple(r) for r in left.collect()} == {("a", 1), ("a", 2), ("b", 0), ("b", 2)}
    # the rest is written, one of it refused again; a refused new version does not hide a good old one
    segments.commit_segments(frames(spark, {("a", 1): (5, 5, True, "v2"), ("b", 0): (2, 3, True, "v2"), ("a", 0): (1, 5, True, "v2")}), store)
    assert content(spark, store) == {("a", 0, "v1"): 5, ("b", 1, "v1"): 3, ("a", 1, "v2"): 5}
    segments.commit_segments(frames(spark, {("a", 0): (5, 5, True, "v3")}), store)
    assert content(spark, store)[("a", 0, "v3")] == 5 and ("a", 0, "v1") not in content(spark, store)
    states = {(r.source_id, r.segment_index): (r.versions, r.present, r.refused, r.frames) for r in segments.segment_states(segments.read_ledger(spark, store)).collect()}
    assert states == {("a", 0): (3, True, None, 5), ("a", 1): (2, True, None, 5), ("b", 0): (2, False, "frame count", None), ("b", 1): (1, True, None, 3)}


def test_repeated_frames_are_refused(spark, store):
    rows = frames(spark, {("a", 0): (3, 6, True, "v1")})
    segments.commit_segments(rows.union(rows), store)
    assert [r.reason for r in segments.read_ledger(spark, store).collect()] == ["frames are not in order"]


def test_a_failure_half_way_leaves_old_segments_whole(spark, store):
    segments.commit_segments(frames(spark, {(s, k): (5, 5, True, "old") for s in "abcd" for k in range(8)}), store)
    before, parts = content(spark, store), files(store, "ledger/parts")

    @F.udf("string")
    def breaks(source, segment, frame):
        if (source, segment, frame) == ("c", 3, 302):
            raise RuntimeError("the model stopped")
        return "new"

    new = frames(spark, {(s, k): (5, 5, True, "") for s in "abcd" for k in range(8)}).withColumn("pixels", breaks("source_id", "segment_index", "frame_index"))
    late = new.repartition("source_id", "segment_index").sortWithinPartitions("source_id", "segment_index", "frame_index")
    with pytest.raises(Exception, match="the model stopped"):
        segments.commit_segments(late, store)
    assert content(spark, store) == before and len(files(store, "ledger/commits")) == 1
    orphans = set(files(store, "ledger/parts")) - set(parts)
    assert segments.read_ledger(spark, store).count() == 32  # whatever finished tasks left is not in a commit
    segments.commit_segments(frames(spark, {(s, k): (5, 5, True, "new") for s in "abcd" for k in range(8)}), store)
    assert set(content(spark, store)) == {(s, k, "new") for s in "abcd" for k in range(8)} and orphans is not None


def test_a_task_that_fails_removes_its_files(store):
    schema = segments.pa.schema([("source_id", segments.pa.string()), ("segment_index", segments.pa.int64()), ("frame_index", segments.pa.int64())])
    batch = lambda s, k, f: segments.pa.RecordBatch.from_arrays([[s] * len(f), [k] * len(f), f], schema=schema)

    def source():
        yield batch("a", 0, [1, 2])
        yield batch("a", 1, [3])
        raise RuntimeError("lost")

    writer = segments._Writer({"path": store, "file_bytes": "1"})
    with pytest.raises(RuntimeError, match="lost"):
        writer.write(source())
    assert files(store, "data") == files(store, "ledger/parts") == []
    with pytest.raises(ValueError, match="do not come together"):
        writer.write(iter([batch("a", 0, [1]), batch("a", 1, [2]), batch("a", 0, [3])]))
    message = writer.write(iter([batch("a", 0, [1, 2]), batch("a", 0, [3]), batch("a", 1, [4]), batch("a", 1, [])]))
    assert len(message.files) == 2 == len(files(store, "data"))
    writer.abort([message, None])
    assert files(store, "data") == files(store, "ledger/parts") == []
    assert writer.write(iter([])).part is None


def test_a_repeated_job_changes_nothing(spark, store):
    first = frames(spark, {("a", k): (4, 4, True, "v1") for k in range(6)})
    segments.commit_segments(first, store, commit="job-1")
    data = files(store, "data")
    segments.commit_segments(first, store, commit="job-1")
    assert files(store, "data") == data and segments.read_ledger(spark, store).count() == 6
    assert content(spark, store) == {("a", k, "v1"): 4 for k in range(6)}


def test_empty_store(spark, store):
    assert segments.read_segments(spark, store, SCHEMA).count() == 0
    segments.commit_segments(frames(spark, {("a", 0): (1, 1, True, "x")}).limit(0), store)
    assert segments.read_ledger(spark, store).count() == 0


def test_small_segments_share_row_groups(tmp_path, monkeypatch):
    """A writer's memory holds a row group's footer for each group, so segments must not each get their own."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(segments, "LEDGER_ROWS", 7)
    batch = pa.record_batch({"source_id": [f"s{i // 3:03d}" for i in range(300)], "segment_index": [0] * 300, "frame_index": list(range(300))})
    writer = segments._Writer({"path": str(tmp_path)})
    done = writer.write(iter([batch.slice(0, 100), batch.slice(100)]))
    (file,) = (tmp_path / "data").iterdir()
    assert pq.ParquetFile(file).num_row_groups == 1 and pq.read_table(file).num_rows == 300
    ledger = pq.read_table(tmp_path / "ledger/parts" / f"{done.part}.parquet")
    assert ledger.num_rows == 100 and set(ledger["frames"].to_pylist()) == {3}
