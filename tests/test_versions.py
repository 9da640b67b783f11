"""Versioned tables: any split into batches gives the full recomputation, and only touched buckets are rewritten."""

import os
import random

import pytest

from framelane.sources import versions

SCHEMA = "model string, at long, rating int, deleted boolean"


def changes(rng, n):
    return [(f"m{rng.randrange(60)}", rng.randrange(1000), rng.choice([None, 1, 2, 3]), rng.choice([None, False, False, True])) for _ in range(n)]


def recomputed(rows):
    best = {}
    for model, at, rating, deleted in rows:
        row = (at, rating is not None, rating or 0, bool(deleted))
        best[model] = max(best.get(model, row), row)
    return {m: (r[0], r[2] if r[1] else None) for m, r in best.items() if not r[3]}


def live(spark, path, version=None):
    return {r.model: (r.at, r.rating) for r in versions.read_table(spark, path, version).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_equals_recomputation(spark, tmp_path, seed):
    rng, path, done = random.Random(seed), str(tmp_path / "t"), []
    for size in (1, 0, 40, 200, 3):
        batch = changes(rng, size)
        done += batch
        manifest = versions.apply_changes(spark.createDataFrame(batch, SCHEMA), path, ["model"], ["at"], buckets=16)
        assert live(spark, path) == recomputed(done)
    assert manifest["version"] == 4  # the empty batch made none
    assert live(spark, path, 1) == recomputed(done[:1]) and live(spark, path, 2) == recomputed(done[:41])
    again = versions.apply_changes(spark.createDataFrame(done, SCHEMA), path, ["model"], ["at"])
    assert live(spark, path) == recomputed(done) and again["buckets"] == 16


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path, first = str(tmp_path / "t"), changes(random.Random(3), 500)
    before = versions.apply_changes(spark.createDataFrame(first, SCHEMA), path, ["model"], ["at"], buckets=16)
    after = versions.apply_changes(spark.createDataFrame([("m5", 5000, 9, None)], SCHEMA), path, ["model"], ["at"])
    moved = {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)}
    assert len(moved) == 1 and len(before["folders"]) > 10
    (folder,) = {after["folders"][b] for b in moved}
    assert [d for d in os.listdir(f"{path}/data/{folder}") if d.startswith("_bucket_=")] == [f"_bucket_={b}" for b in moved]
    assert live(spark, path)["m5"] == (5000, 9)


def test_tombstones_and_late_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    for row in (("a", 10, 1, None), ("a", 30, 1, True), ("a", 20, 2, None)):
        versions.apply_changes(spark.createDataFrame([row], SCHEMA), path, ["model"], ["at"])
    assert live(spark, path) == {} and live(spark, path, 1) == {"a": (10, 1)}
    versions.apply_changes(spark.createDataFrame([("a", 40, 3, False)], SCHEMA), path, ["model"], ["at"])
    assert live(spark, path) == {"a": (40, 3)}


def test_a_writer_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no snapshot"):
        versions.read_table(spark, path)
    versions.apply_changes(spark.createDataFrame([("a", 1, 1, None)], SCHEMA), path, ["model"], ["at"])
    stale = versions.read_manifest(path)
    versions.apply_changes(spark.createDataFrame([("b", 1, 1, None)], SCHEMA), path, ["model"], ["at"])
    monkeypatch.setattr(versions, "read_manifest", lambda *_: stale)
    with pytest.raises(RuntimeError, match="another snapshot"):
        versions.apply_changes(spark.createDataFrame([("c", 1, 1, None)], SCHEMA), path, ["model"], ["at"])
    monkeypatch.undo()
    assert live(spark, path) == {"a": (1, 1), "b": (1, 1)}
