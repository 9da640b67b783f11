"""Sharding by a Feistel permutation of global row numbers.

Every row gets a row number in [0, n). A balanced Feistel network permutes the smallest even-bit domain that holds n,
and walks its cycle until the value falls below n, so the permutation is one of [0, n) itself. Row number, shard and slot
can each be computed from the others without a shuffle of the data (``locate`` and ``row_at``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Row numbers are counted in this many hash buckets, whatever the size of the table.
BUCKETS = 4096


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of [0, n); equal keys give equal permutations on every machine."""

    n: int
    key: int = 1
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _f(self, right: np.ndarray, i: int) -> np.ndarray:
        salt = (self.key * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) % 2**64
        x = right + np.uint64(salt)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & mask
        for i in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = right ^ self._f(left, i), left
            else:
                left, right = right, left ^ self._f(right, i)
        return (left << h) | right

    def apply(self, rows: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._once(np.asarray(rows, dtype=np.uint64), back)
        while (out := np.flatnonzero(x >= np.uint64(self.n))).size:
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)


def locate(row: int, n: int, shards: int, key: int = 1) -> tuple[int, int]:
    """Shard and slot of one row number."""
    at = int(Feistel(n, key).apply(np.array([row]))[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, n: int, shards: int, key: int = 1) -> int:
    """The row number that stands in a slot of a shard."""
    return int(Feistel(n, key).apply(np.array([slot * shards + shard]), back=True)[0])


def number_rows(df: DataFrame, order: list[str], name: str = "row", total: str = "n_rows") -> DataFrame:
    """Row numbers from 0, reproducible for equal rows, and the number of rows.

    Rows are numbered by (hash bucket of the ``order`` columns, ``order``). Buckets hash all of ``order``, so no key is hot;
    rows equal in all of ``order`` are interchangeable. Only the counts of the buckets meet in one task.
    """
    bucket = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int"))
    ranked = bucket.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    counts = ranked.groupBy("_bucket").agg(F.max("_rank").cast("long").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total),
    )
    out = ranked.join(offsets, "_bucket")
    return out.withColumn(name, F.col("_offset") + F.col("_rank") - 1).drop("_bucket", "_rank", "_offset")


def shard_rows(df: DataFrame, shards: int, order: list[str], key: int = 1) -> DataFrame:
    """Adds ``shard`` and ``slot`` (from 0, gapless in each shard); counts of shards differ by one at most.

    ``df`` must have no columns ``shard``, ``slot``, ``row``, ``n_rows``. An empty table gives an empty table.
    """

    @F.pandas_udf("long")
    def permuted(row: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(Feistel(int(n.iloc[0]), key).apply(row.to_numpy())) if len(row) else row

    placed = number_rows(df, order).withColumn("_at", permuted("row", "n_rows"))
    return placed.withColumns(
        {"shard": F.pmod("_at", F.lit(shards)).cast("int"), "slot": F.expr(f"_at div {shards}").cast("long")}
    ).drop("_at", "row", "n_rows")


def shard_documents(docs: DataFrame, shards: int = 40, key: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The place of every document under the law ``rows``.

    Null texts count as empty (size 16, checksum 0); null ids are ids like others; rows equal in id and text are
    interchangeable. Other columns of ``docs`` are not read, so their names cannot clash. ``grown_shard`` belongs to another law and is null.
    """
    text = F.col(text_col)
    light = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_text"),
    )
    placed = shard_rows(light, shards, ["doc_id", "_text", "text_crc32", "size"], key)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order; ``placed`` has ``shard`` and ``slot`` beside the data."""
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
