"""The snapshot folder source: versions, groups, filters, restarts."""

import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framelane.sources import snapshots

FIELDS = "job STRING, n BIGINT"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, rows, second):
        file = tmp_path / "in" / name
        file.parent.mkdir(exist_ok=True)
        file.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows))
        os.utime(file, (1_700_000_000 + second,) * 2)

    put.path, put.state, put.out = (str(tmp_path / n) for n in ("in", "state", "out"))
    return put


def run(spark, put, **options):
    rows = snapshots.stream_snapshots(spark, put.path, FIELDS, settle_seconds="0", **options)
    query = rows.writeStream.option("checkpointLocation", put.state).trigger(availableNow=True).format("parquet").start(put.out)
    query.awaitTermination(120)
    assert query.exception() is None
    return Counter((r.file_name, r.job, r.n) for r in spark.read.schema(rows.schema).parquet(put.out).collect())


def test_restarts_give_every_version_once(spark, folder):
    folder("a.json", [{"job": "a", "n": 1}], 1)
    folder("sub/b.json", [{"job": "b", "n": 1}], 1)
    folder("_hidden.json", [{"job": "x", "n": 1}], 1)
    first = run(spark, folder)
    assert first == {("a.json", "a", 1): 1, ("sub/b.json", "b", 1): 1}
    assert run(spark, folder) == first  # nothing new
    folder("a.json", [{"job": "a", "n": 2}], 5)  # replaced in place
    folder("c.json", [{"job": "c", "n": 1}], 5)
    folder("d.json", ["not json"], 6)
    want = first + Counter({("a.json", "a", 2): 1, ("c.json", "c", 1): 1})
    assert run(spark, folder) == want
    folder("c.json", [{"job": "c", "n": 3}], 5)  # same time and name: the same version
    assert run(spark, folder) == want


def test_an_uncommitted_batch_is_repeated_and_no_other(spark, folder):
    folder("a.json", [{"job": "a", "n": 1}], 1)
    folder("b.json", [{"job": "b", "n": 1}], 2)
    seen = Counter()

    def fail_once(batch, number):
        rows = [(r.job, r.n) for r in batch.collect()]
        if ("c", 1) in rows and not seen["failed"]:
            seen["failed"] = 1
            raise RuntimeError("stop here")
        seen.update(rows)

    def go():
        rows = snapshots.stream_snapshots(spark, folder.path, FIELDS, settle_seconds="0")
        return rows.writeStream.option("checkpointLocation", folder.state).trigger(availableNow=True).foreachBatch(fail_once).start()

    go().awaitTermination(60)
    folder("c.json", [{"job": "c", "n": 1}], 3)
    with pytest.raises(Exception, match="stop here"):
        go().awaitTermination(60)
    folder("d.json", [{"job": "d", "n": 1}], 4)  # after the failed batch was planned
    for _ in range(2):  # the planned batch, then what is new
        go().awaitTermination(60)
    assert seen == {("a", 1): 1, ("b", 1): 1, ("c", 1): 1, ("d", 1): 1, "failed": 1}


def test_offsets_order_and_groups(folder):
    for i in range(20):
        folder(f"{i:02d}.json", [{"job": "j" * 50, "n": i}], i // 4)
    options = {"path": folder.path, "group_bytes": "200", "settle_seconds": "0"}
    stream = snapshots._Stream(options)
    assert stream.latestOffset() == {"modified": 1_700_000_004 * 10**6, "name": "19.json"}
    middle = {"modified": 1_700_000_002 * 10**6, "name": "09.json"}
    names = lambda groups: [v.name for g in groups for v in g.value]
    before, after = stream.partitions(snapshots.START, middle), stream.partitions(middle, stream.latestOffset())
    assert names(before) + names(after) == [f"{i:02d}.json" for i in range(20)] and len(names(before)) == 10
    assert all(sum(v.size for v in g.value) <= 200 for g in before + after) and len(before) > 3
    folder("09.json", [{"job": "new", "n": 0}], 50)  # rewritten after planning: left to its next version
    read = [r["file_name"] for g in before for b in stream.read(g) for r in b.to_pylist()]
    assert read == [f"{i:02d}.json" for i in range(9)]
    waiting = snapshots._Stream({**options, "settle_seconds": str(time.time() - 1_700_000_003)})
    assert waiting.latestOffset()["name"] == "15.json"


def test_batch_reads_picked_files_only(spark, folder):
    for i in range(6):
        folder(f"{i}.json", [{"job": "j", "n": k} for k in range(i)], i)
    rows = snapshots.read_snapshots(spark, folder.path, FIELDS, lines="true")
    assert rows.groupBy("file_name").count().count() == 5 and rows.count() == 15
    picked = snapshots.read_snapshots(spark, folder.path, FIELDS, "file_name IN ('2.json', '3.json') AND modified >= timestamp_seconds(1700000003)", lines="true")
    assert Counter(r.file_name for r in picked.collect()) == {"3.json": 3}
    reader = snapshots._Batch({"path": folder.path})
    kept = list(reader.pushFilters([snapshots.GreaterThan(("file_name",), "3.json"), snapshots.EqualTo(("body",), "x")]))
    assert [f.attribute for f in kept] == [("body",)] and [v.name for g in reader.partitions() for v in g.value] == ["4.json", "5.json"]
    assert snapshots.read_snapshots(spark, folder.path + "/none", FIELDS).select(F.count("*")).first()[0] == 0
