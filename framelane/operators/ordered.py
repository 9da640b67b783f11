"""Ordered analytics that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, which fails when one clip or job holds a
large share of the table. The operators here window inside ``(key, block)`` instead, where ``block`` is any column
that is non-decreasing in the sort order (a frame range, a time bucket). What crosses a block edge is carried by a
table with one row per block, built with map-side aggregation.

Keys are identifiers and must not be null; the sort order must be total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

FRAME_BLOCK = 65_536
TIME_BLOCK_SECONDS = 3_600
SALTS = 64


def index_block(index: Column | str, size: int = FRAME_BLOCK) -> Column:
    """Block of a dense integer order column: at most ``size`` rows per key and block."""
    column = F.col(index) if isinstance(index, str) else index
    return F.floor(column / F.lit(size)).cast("bigint")


def time_block(ts: Column | str, seconds: int = TIME_BLOCK_SECONDS) -> Column:
    """Block of an event-time order column."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(column.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def time_block_seconds(df: DataFrame, keys: Sequence[str], ts: str, target_rows: int = 1_000_000) -> int:
    """Bucket width that puts about ``target_rows`` rows of the densest key into one block (one aggregate job)."""
    start, end = (F.unix_seconds(f(F.col(ts).cast("timestamp"))) for f in (F.min, F.max))
    span = F.greatest(F.lit(1).cast("bigint"), end - start)
    per_key = df.groupBy(*keys).agg((F.count(F.lit(1)) / span).alias("rate"))
    densest = per_key.agg(F.max("rate")).first()[0] or 0.0
    return max(1, int(target_rows / densest)) if densest > 0 else TIME_BLOCK_SECONDS


def _before_block(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_block")


def blocked_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], block: Column, name: str = "row_number"
) -> DataFrame:
    """1-based position of each row in its key, as BIGINT."""
    staged = df.withColumn("_block", block)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        staged.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_block"], "left")
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_block", "_local", "_offset")
    )


def blocked_lag(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    values: dict[str, Column | str],
) -> DataFrame:
    """Add, for each ``new name -> expression``, the expression of the previous row of the key (null for the first)."""
    staged = df.withColumn("_block", block).withColumn(
        "_now", F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in values.items()])
    )
    tails = (
        staged.groupBy(*keys, "_block")
        .agg(F.max_by("_now", F.struct(*order)).alias("_tail"))
        .select(*keys, "_block", F.lag("_tail").over(_before_block(keys)).alias("_carry"))
    )
    local = Window.partitionBy(*keys, "_block").orderBy(*order)
    out = (
        staged.withColumn("_previous", F.lag("_now").over(local))
        .withColumn("_head", F.row_number().over(local) == 1)
        .join(tails, [*keys, "_block"], "left")
        .withColumn("_previous", F.when(F.col("_head"), F.col("_carry")).otherwise(F.col("_previous")))
    )
    kept = [F.col(c) for c in df.columns]
    return out.select(*kept, *[F.col(f"_previous.{n}").alias(n) for n in values])


def blocked_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    sums: dict[str, Column | str] | None = None,
    maxima: dict[str, Column | str] | None = None,
) -> DataFrame:
    """Running sums and maxima over each key in sort order, current row included."""
    sums, maxima = sums or {}, maxima or {}
    staged = df.withColumn("_block", block)

    def expr(value: Column | str) -> Column:
        return F.col(value) if isinstance(value, str) else value

    totals = staged.groupBy(*keys, "_block").agg(
        *[F.sum(expr(v)).alias(f"_total_{n}") for n, v in sums.items()],
        *[F.max(expr(v)).alias(f"_total_{n}") for n, v in maxima.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_block",
        *[F.sum(f"_total_{n}").over(earlier).alias(f"_carry_{n}") for n in sums],
        *[F.max(f"_total_{n}").over(earlier).alias(f"_carry_{n}") for n in maxima],
    )
    local = (
        Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = staged
    for name, value in sums.items():
        out = out.withColumn(f"_local_{name}", F.sum(expr(value)).over(local))
    for name, value in maxima.items():
        out = out.withColumn(f"_local_{name}", F.max(expr(value)).over(local))
    out = out.join(carried, [*keys, "_block"], "left")
    both = {
        **{
            n: F.when(
                F.col(f"_local_{n}").isNotNull() | F.col(f"_carry_{n}").isNotNull(),
                F.coalesce(F.col(f"_local_{n}"), F.lit(0)) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0)),
            )
            for n in sums
        },
        **{n: F.greatest(f"_local_{n}", f"_carry_{n}") for n in maxima},
    }
    return out.select(*[F.col(c) for c in df.columns], *[c.alias(n) for n, c in both.items()])


def exact_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "median",
    accuracy: int = 10_000,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact median per key (mean of the two middle values), one row per key that has a non-null value.

    ``extra`` aggregates of the non-null rows are computed in the same pass as the sketch.

    A mergeable quantile sketch brackets the middle ranks; exact counts below the bracket and the few distinct values
    inside it then give the median. No task ever holds a whole group.
    """
    half_width = 3.0 / accuracy
    extra = extra or {}
    present = df.where(F.col(value).isNotNull())
    rows = present.select(*keys, F.col(value).cast("double").alias("_v"))
    brackets = present.withColumn("_v", F.col(value).cast("double")).groupBy(*keys).agg(
        F.percentile_approx("_v", [0.5 - half_width, 0.5 + half_width], accuracy).alias("_b"),
        F.count(F.lit(1)).alias("_n"),
        *[c.alias(f"_x_{n}") for n, c in extra.items()],
    )
    carried = [f"_x_{n}" for n in extra]
    if keys:  # a key's rows spread over the salts, so that no task gets a whole key
        salted = brackets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        bracketed = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"])
    else:
        whole = rows.withColumn("_all", brackets.select(F.struct("_b", "_n", *carried)).scalar())
        bracketed = whole.select("_v", "_all.*")
    placed = bracketed.select(
        *keys,
        "_n",
        *carried,
        # everything below the bracket collapses into one row per task before the shuffle
        F.when(F.col("_v") < F.col("_b")[0], F.lit(None).cast("double")).otherwise(F.col("_v")).alias("_v"),
        (F.col("_v") <= F.col("_b")[1]).alias("_near"),
    )
    counted = placed.where("_near").groupBy(*keys, "_n", "_v").agg(
        F.count(F.lit(1)).alias("_c"), *[F.max(c).alias(c) for c in carried]
    )
    upto = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.withColumn("_hi", F.sum("_c").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_c") + 1)
    first, second = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    middle = ranked.withColumn(
        "_w",
        F.when((F.col("_lo") <= first) & (first <= F.col("_hi")), 1).otherwise(0)
        + F.when((F.col("_lo") <= second) & (second <= F.col("_hi")), 1).otherwise(0),
    ).where("_w > 0")
    total, weight = F.sum(F.col("_v") * F.col("_w")), F.sum("_w")
    return middle.groupBy(*keys).agg(
        F.when((weight == 2) & (F.count("_v") == F.count(F.lit(1))), total / 2)
        .otherwise(F.raise_error(F.lit("median bracket missed the middle rank")).cast("double"))
        .alias(name),
        *[F.max(f"_x_{n}").alias(n) for n in extra],
    )


def salted_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with a table of few rows per key, without a whole key in one task: the table is repeated per salt."""
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    large = (T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    plain = [f.name for f in rows.schema.fields if not isinstance(f.dataType, large)]
    salt = F.pmod(F.xxhash64(*plain), F.lit(SALTS))
    return rows.withColumn("_salt", salt.cast("int")).join(spread, [*keys, "_salt"], how).drop("_salt")


def _bisect(key: Column, edges: Column, bits: int = 26) -> Column:
    """Number of edges below ``key`` in a sorted array of less than ``2 ** bits`` edges."""
    return F.aggregate(
        F.array(*[F.lit(2**k) for k in reversed(range(bits))]),
        F.lit(0),
        lambda low, step: F.when(F.get(edges, low + step - 1) < key, low + step).otherwise(low),
    )


def global_row_number(
    df: DataFrame, order: Sequence[str], name: str = "position", rows_per_block: int = 2_000_000, reverse: bool = False, most_blocks: int = 4_096
) -> DataFrame:
    """1-based position in a total order over the whole table, without a single-task window.

    ``order`` is ascending, nulls first, and must be total; ``reverse`` counts from the other end.

    The sort keys of one row in ``rows_per_block / 4``, chosen by a hash of the key, are the edges of blocks; so the number of blocks
    follows the number of rows, and a recomputed task puts a row into the same block. Beyond some ``most_blocks`` blocks they grow instead, so
    the list of edges does not. All of it is one lazy query.
    """
    key = F.struct(*[F.col(c) for c in order])
    total = df.select(F.lit(1).alias("_one")).agg(F.count("_one")).scalar()
    share = F.greatest(F.lit(max(1, rows_per_block // 4)), F.ceil(total / most_blocks)).cast("bigint")
    chosen = df.where(F.pmod(F.xxhash64(*order), share) == 0)
    edges = chosen.select(key.alias("_e")).agg(F.array_sort(F.collect_list("_e"))).scalar()
    cut = df.withColumn("_edges", edges).withColumn("_at", _bisect(key, F.col("_edges"), (4 * most_blocks).bit_length())).drop("_edges")
    placed = blocked_row_number(cut, [], order, F.col("_at"), name).drop("_at")
    if not reverse:
        return placed
    return placed.withColumn(name, (total + 1 - F.col(name)).cast("bigint"))
