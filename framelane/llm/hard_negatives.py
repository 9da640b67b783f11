"""Hard negatives by a secondary sort.

Scores of an anchor with other rows become records whose packed key is (anchor, descending score, negative or positive, id).
``repartitionAndSortWithinPartitions`` puts an anchor's records together and in order, and one iterator reads them: the first positives open
a window of scores each, a negative goes to every open window that its score lies in and that is not yet full. Only the windows of the
current anchor are held.

Not every pair is shuffled. Rows and anchors are dealt to hashed blocks and meet tile by tile; a tile keeps what can still be among the
first of an anchor: its first positives, and, once the positives of the whole table are known, the first negatives of each window.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.rdd import portable_hash
from pyspark.sql import Column, DataFrame, functions as F

from framelane.llm.shared import checkpointed

#: Rules of the windows: a negative's score lies between these percentages of the positive's.
LEAST, MOST = 30, 90
#: Components beyond this count as this, so that scores of vectors of up to 2^13 components fit a long.
LIMIT = 2**24
KEY = ">QQBQ"
OFFSET = 2**63


def pack_key(anchor: int, score: int, negative: bool, other: int) -> bytes:
    """Bytes that sort by anchor, descending score, positives before negatives, id."""
    return struct.pack(KEY, anchor + OFFSET, OFFSET - 1 - score, negative, other + OFFSET)


def unpack_key(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, other = struct.unpack(KEY, key)
    return anchor - OFFSET, OFFSET - 1 - score, bool(negative), other - OFFSET


def window(score: int) -> tuple[int, int]:
    """The lowest and the highest score of a negative for a positive of ``score``; empty below 0."""
    return -(-LEAST * score // 100), MOST * score // 100


def whole_vectors(vectors: DataFrame, scale: int, changed: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, vector array<int>`` of the rows that take part, one per id (of rows with one id the smallest label and vector)."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    label = F.col(label_col).cast("long")
    own = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.when(F.col(id_col) % changed == 0, (label + 1) % 10).otherwise(label).alias("label"),
        whole.alias("vector"),
    )
    return own.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


def block_of(column: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit("block")), F.lit(n)).cast("int")


def tile_sides(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> tuple[DataFrame, DataFrame]:
    """Rows once per anchor block, anchors once per row block; a tile is a pair of blocks of vectors of one length."""
    dims = F.size("vector").alias("dims")
    by_row, by_anchor = block_of(F.col("vec_id"), n_rows), block_of(F.col("vec_id"), n_anchors)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    own = lambda df: [F.col(c).alias(c) for c in df.columns]  # noqa: E731  new columns, as both sides come from one table
    return rows.select(dims, by_row.alias("r"), every(n_anchors, "a"), *own(rows)), anchors.select(dims, by_anchor.alias("a"), every(n_rows, "r"), *own(anchors))


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("vector").combine_chunks().flatten().to_numpy()
    return flat.reshape(table.num_rows, len(flat) // table.num_rows)


def tile_scores(left: pa.Table, right: pa.Table) -> tuple[pa.Table, Iterator[tuple[dict, np.ndarray]]]:
    """The rows of a tile in order of id, and per anchor its row and its scores with them; exact."""
    left = left.sort_by("vec_id")
    if not left.num_rows or not right.num_rows:  # a block of rows without anchors of its length, or the reverse
        return left, iter(())
    x, y = _matrix(left), _matrix(right)
    most = lambda m: int(np.abs(m).max()) if m.size else 0
    kind = np.float64 if most(x) * most(y) * max(x.shape[1], 1) < 2**53 else np.int64
    scores = (y.astype(kind) @ x.T.astype(kind)).astype(np.int64)
    columns = right.drop_columns(["vector"]).to_pylist()
    return left, zip(columns, scores)


def first(scores: np.ndarray, allowed: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores among ``allowed`` (places in order of id), ties by place, in order."""
    if len(allowed) > n:
        own = scores[allowed]
        least = np.partition(own, len(own) - n)[len(own) - n]
        above, ties = allowed[own > least], allowed[own == least]
        allowed = np.sort(np.concatenate([above, ties[: n - len(above)]]))
    return allowed[np.argsort(-scores[allowed], kind="stable")]


RECORDS = pa.schema([("key", pa.binary())])


def _positives(n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, scored = tile_scores(left, right)
        ids, labels, keys = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), []
        for anchor, scores in scored:
            me = anchor["vec_id"]
            places = first(scores, np.flatnonzero((labels == anchor["label"]) & (ids != me)), n)
            keys += [pack_key(me, int(scores[p]), False, int(ids[p])) for p in places]
        return pa.table([pa.array(keys, pa.binary())], schema=RECORDS)

    return run


def _negatives(n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, scored = tile_scores(left, right)
        ids, labels, keys = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), []
        for anchor, scores in scored:
            other, found = labels != anchor["label"], set()
            for low, high in set(map(window, anchor["positive_scores"])):
                found.update(first(scores, np.flatnonzero(other & (scores >= low) & (scores <= high)), n).tolist())
            keys += [pack_key(anchor["vec_id"], int(scores[p]), True, int(ids[p])) for p in found]
        return pa.table([pa.array(keys, pa.binary())], schema=RECORDS)

    return run


def in_order(records: DataFrame) -> RDD:
    """Packed keys, an anchor's in one partition, sorted; Spark spills what does not fit."""
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = records.rdd.map(lambda row: (bytes(row.key), None))
    return pairs.repartitionAndSortWithinPartitions(n, lambda key: portable_hash(key[:8])).keys()


def best_positives(keys: Iterator[bytes], n: int) -> Iterator[tuple]:
    """Anchor, positive, score of the first ``n`` positives of each anchor, from keys in order."""
    now, seen = None, 0
    for key in keys:
        anchor, score, _, other = unpack_key(key)
        now, seen = (now, seen + 1) if anchor == now else (anchor, 1)
        if seen <= n:
            yield anchor, other, score


def mine(keys: Iterator[bytes], n: int) -> Iterator[tuple]:
    """Negatives in order of each anchor's windows, from keys in order; a window closes when it has ``n`` or the score falls below it."""
    now, windows = None, []
    for key in keys:
        anchor, score, negative, other = unpack_key(key)
        if anchor != now:
            now, windows = anchor, []
        if not negative:
            windows.append([other, score, *window(score), 0])
            continue
        for w in windows:
            if w[2] <= score <= w[3]:
                w[4] += 1
                yield anchor, w[0], w[4], other, w[1], score
        windows = [w for w in windows if w[4] < n and w[2] <= score]


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 10, scale: int = 256, anchor_step: int = 100, changed: int = 7,
    rows_per_tile: int = 2048, anchors_per_tile: int = 128, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: per anchor and positive the first negatives.

    Anchors are the rows whose id ``anchor_step`` divides; where ``changed`` divides the id, the label is the next of ten. Rows without id,
    label or vector, or with a component that is null or not finite, take no part. Rows with one id are one row, that with the smallest
    label and vector; equal scores come in order of id, at any number of equal vectors; vectors of different lengths have no score; a
    positive with a score below 0 has no negatives, one with 0 those with 0; components of ``LIMIT`` / ``scale`` and more count as that. An
    empty table gives an empty table; other columns are not read. Work is rows x anchors, in tiles; a tile passes on
    ``positives * negatives`` records per anchor at most, whatever the ties.
    """
    rows = checkpointed(whole_vectors(vectors, scale, changed, id_col, vector_col, label_col))
    anchors = rows.where(F.col("vec_id") % anchor_step == 0)
    n_rows, n_anchors = (max(1, -(-df.count() // size)) for df, size in ((rows, rows_per_tile), (anchors, anchors_per_tile)))
    spark = vectors.sparkSession

    def tiles(own: DataFrame, run) -> DataFrame:
        left, right = tile_sides(rows, own, n_rows, n_anchors)
        return left.groupBy("dims", "a", "r").cogroup(right.groupBy("dims", "a", "r")).applyInArrow(run, "key binary")

    known = in_order(tiles(anchors, _positives(positives))).mapPartitions(lambda keys: best_positives(keys, positives))
    found = checkpointed(spark.createDataFrame(known, "vec_id long, positive_id long, score long"))
    scores = found.groupBy("vec_id").agg(F.collect_list("score").alias("positive_scores"))
    record = F.udf(lambda anchor, score, other: pack_key(anchor, score, False, other), "binary")
    records = tiles(anchors.join(scores, "vec_id"), _negatives(negatives)).union(found.select(record("vec_id", "score", "positive_id")))
    result = in_order(records).mapPartitions(lambda keys: mine(keys, negatives))
    return spark.createDataFrame(result, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
