"""The planners as table functions against the DataFrame planners."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framelane.plans import segments, table_functions, tiles


@pytest.fixture(scope="module")
def clips(spark):
    rng = random.Random(3)
    rows = [(i, f"c{i}", rng.choice([None, 0, -5, 1, 4, 47, 48, 100, 999, 2401, 100_000]), rng.choice([None, 0.0, -1.0, 0.05, 23.976, 24.0, 25.0, 24.85, 120.0])) for i in range(120)]
    df = spark.createDataFrame(rows, "source_id long, label string, frame_count long, frame_rate double")
    df.createOrReplaceTempView("clips")
    sizes = [(i, rng.choice([None, 0, 1, 7, 64, 65, 200, 512, 1000]), rng.choice([0, 1, 8, 63, 64, 256, 300, 720])) for i in range(150)]
    spark.createDataFrame(sizes, "frame_index long, width int, height int").createOrReplaceTempView("sizes")
    table_functions.register(spark)
    return df


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert dict(a.dtypes) == dict(b.dtypes)
    rows = [Counter(tuple(r) for r in df.select(*columns).collect()) for df in (a, b)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("by", ["", " PARTITION BY source_id"])
@pytest.mark.parametrize("seconds, single", [(None, False), (10, False), (3.3, False), (0, False), (-1, False), (10, True)])
def test_segments(spark, clips, seconds, single, by):
    options = f"seconds => {'NULL' if seconds is None else seconds}, single => {str(single).lower()}"
    sql = spark.sql(f"SELECT * FROM plan_segments(TABLE(clips){by}, frames => 'frame_count', fps => 'frame_rate', {options})")
    same(sql, segments.plan_segments(clips, ("source_id", "label"), seconds=seconds, single=single))


@pytest.mark.parametrize("chunk, radius, minimum", [(32, 2, 5), (1, 0, 0), (0, 3, 9), (7, 20, 60)])
def test_chunks(spark, clips, chunk, radius, minimum):
    small = clips.where("frame_count < 3000 OR frame_count IS NULL").drop("frame_rate")
    small.createOrReplaceTempView("small")
    sql = spark.sql(f"SELECT * FROM plan_temporal_chunks(TABLE(small) PARTITION BY source_id, chunk => {chunk}, radius => {radius}, minimum => {minimum})")
    same(sql, segments.plan_temporal_chunks(small, ("source_id", "label"), chunk=chunk, radius=radius, minimum=minimum))


@pytest.mark.parametrize("tile, overlap, mode, multiple", [(64, 0, "crop", 1), (0, 0, "crop", 1), (1000, 9, "average", 4), (64, 16, "average", 1), (50, 90, "average", 8), (64, -3, "average", 0)])
def test_tiles(spark, clips, tile, overlap, mode, multiple):
    positive = spark.table("sizes").where("width > 0 AND height > 0")
    positive.createOrReplaceTempView("positive")
    sql = spark.sql(f"SELECT * FROM plan_tiles(TABLE(positive), tile => {tile}, overlap => {overlap}, mode => '{mode}', multiple => {multiple})")
    same(sql, tiles.plan_tiles(positive, tile, overlap, mode, multiple))


@pytest.mark.parametrize(
    "call, message",
    [
        ("plan_segments(TABLE(clips), frames => 'none')", "is not a column"),
        ("plan_segments(TABLE(clips), frames => 'label')", "is not a number"),
        ("plan_segments(TABLE(SELECT 1 AS frame_count, 2.0 AS frame_rate, 3 AS start_frame))", "names of the plan"),
        ("plan_tiles(TABLE(sizes), tile => 9, mode => 'spiral')", "unknown tile mode"),
        ("plan_tiles(TABLE(sizes))", "tile => size"),
        ("plan_temporal_chunks(TABLE(clips), radius => -1)", "must not be negative"),
    ],
)
def test_wrong_calls_fail_before_anything_runs(spark, clips, call, message):
    with pytest.raises(Exception, match=message):
        spark.sql(f"SELECT * FROM {call}").schema


def test_no_shuffle_without_partitions(spark, clips):
    plan = spark.sql("SELECT * FROM plan_temporal_chunks(TABLE(clips))")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert F is not None
