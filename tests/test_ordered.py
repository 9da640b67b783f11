"""Ordered operators against plain windows, with one key holding most rows, and where the rows end up."""

import random

import pytest
from pyspark.sql import Window, functions as F

from framelane.operators.ordered import (
    blocked_lag,
    blocked_row_number,
    blocked_running,
    exact_median,
    global_row_number,
    index_block,
    time_block,
    time_block_seconds,
)


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.choice([None, *range(9)])) for i in range(3000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, i bigint, v bigint").repartition(3).cache()


def differences(df, **pairs):
    condition = F.lit(False)
    for a, b in pairs.items():
        condition = condition | ~F.col(a).eqNullSafe(F.col(b))
    return df.where(condition).count()


def plain():
    return Window.partitionBy("k").orderBy("i")


def test_row_number(hot):
    out = blocked_row_number(hot, ["k"], ["i"], index_block("i", 100), "n").withColumn("want", F.row_number().over(plain()))
    assert out.count() == 3000 and differences(out, n="want") == 0


def test_lag(hot):
    out = blocked_lag(hot, ["k"], ["i"], index_block("i", 100), {"p": "v", "q": F.col("i") * 2})
    out = out.withColumns({"a": F.lag("v").over(plain()), "b": F.lag(F.col("i") * 2).over(plain())})
    assert out.count() == 3000 and differences(out, p="a", q="b") == 0


def test_running(hot):
    out = blocked_running(hot, ["k"], ["i"], index_block("i", 100), sums={"s": "v"}, maxima={"m": "v"})
    out = out.withColumns({"a": F.sum("v").over(plain()), "b": F.max("v").over(plain())})
    assert out.count() == 3000 and differences(out, s="a", m="b") == 0


def test_no_task_holds_the_hot_key(hot):
    """The big window is partitioned by key and block."""
    plan = blocked_lag(hot, ["k"], ["i"], index_block("i", 100), {"p": "v"})._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_block" in w for w in windows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 100, 1001])
def test_median(spark, n):
    rng = random.Random(n)
    rows = [(k, rng.choice([1.5, 2.0, rng.random() * 100])) for k in "ab" for _ in range(n)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).where("m IS NOT NULL").collect()}
    assert got == pytest.approx(want)


def test_median_with_a_coarse_sketch(spark):
    """The bracket still holds the middle when the sketch is far coarser than the data."""
    df = spark.range(200_000).select((F.xxhash64("id") % 1_000_003).cast("double").alias("v"), (F.col("id") % 2).alias("k"))
    got = {r.k: r["median"] for r in exact_median(df, ["k"], "v", accuracy=200).collect()}
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == want


@pytest.mark.parametrize("reverse", [False, True])
def test_global_position(hot, reverse):
    got = global_row_number(hot, ["v", "k", "i"], "p", rows_per_block=150, reverse=reverse)
    order = Window.orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in ("v", "k", "i")])
    assert differences(got.withColumn("want", F.row_number().over(order)), p="want") == 0
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_sorted_jobs_with_unknown_states(spark):
    """Null sort keys, over many blocks; without a state a job comes first."""
    from framelane.operators.jobs import sort_jobs

    jobs = spark.range(3000).select(
        F.col("id").alias("job_id"), F.when(F.col("id") % 8 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("state"),
        F.when(F.col("id") % 3 > 0, F.lit("L")).alias("label"), (F.col("id") * 7 % 1000).alias("updated_at"),
    )
    got = [r.job_id for r in sort_jobs(jobs, "state", "asc", rows_per_block=100).orderBy("position").collect()]
    rows = [r.asDict() for r in jobs.collect()]
    low = lambda v: (v is not None, (v or "").lower())
    assert got == [r["job_id"] for r in sorted(rows, key=lambda r: (low(r["state"]), low(r["label"]), -r["updated_at"], str(r["job_id"])))]


def test_block_width(spark):
    df = spark.range(10_000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"))
    assert time_block_seconds(df, ["k"], "ts", target_rows=500) in range(495, 506)
    blocks = df.groupBy(time_block("ts", 500)).count().agg(F.max("count")).first()[0]
    assert blocks <= 500


def test_edges_stay_few(spark):
    """More blocks than wanted make the blocks larger, not the list of edges longer."""
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b long").repartition(5)
    want = {r: i for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 1)}
    for blocks in (1, 8, 4096):
        for reverse in (False, True):
            got = {(r.a, r.b): r.position for r in global_row_number(df, ["a", "b"], rows_per_block=4, reverse=reverse, most_blocks=blocks).collect()}
            assert got == ({r: len(rows) + 1 - i for r, i in want.items()} if reverse else want)


def test_storage_tree(spark):
    from collections import defaultdict

    from framelane.operators import jobs

    rng = random.Random(9)
    files = [("/".join(["", *[rng.choice("abc") for _ in range(rng.randrange(5))], f"f{i}"]), rng.choice([None, 0, 5, i])) for i in range(300)]
    files += [("x.txt", 7), ("/", 1), ("//a//b/c", 2), (None, 9)]
    want = defaultdict(lambda: [0, 0, 0, 0])
    for path, size in files:
        if path is None:
            continue
        names = [n for n in path.split("/")[:-1] if n]
        for level in range(len(names) + 1):
            own = level == len(names)
            row = want[("/" + "/".join(names[:level]), level)]
            for i, v in enumerate((own, own * (size or 0), 1, size or 0)):
                row[i] += v
    df = spark.createDataFrame(files, "path string, length long").repartition(3)
    got = {(r.directory, r.level): [r.own_files, r.own_bytes, r.files, r.size_bytes] for r in jobs.storage_tree(df).collect()}
    assert got == want
    assert {k: v for k, v in want.items() if k[1] <= 2} == {(r.directory, r.level): [r.own_files, r.own_bytes, r.files, r.size_bytes] for r in jobs.storage_tree(df, depth=2).collect()}
    assert jobs.storage_tree(df.limit(0)).collect() == []
