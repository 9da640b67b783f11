"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source fall into hashed blocks. A source's target (in words) becomes an exact quota of blocks: whole passes
over all its blocks, then a prefix of the permuted block list. A binary tree over the output shards splits the quotas:
each node draws the left half's share without replacement from its own quotas (a multivariate hypergeometric draw), so
the quotas of all shards add up exactly. Shards then own disjoint ranges of each source's permuted blocks, and are
shuffled locally by a hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from framelane.llm.shared import checkpointed, count_words

BLOCKS = 1024
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SHARDS = 16


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Words wanted per source; ``sizes`` has ``source``, ``source_size``. Result adds ``rank`` (from 1) and ``target``.

    Sources rank by code point, null last, and weights repeat along the ranks. A source wants its weight's part of ``share``
    times all words, at most ``repeats`` times its own; the excess goes to the others by weight until none is above. The
    sources that end at their limit are a prefix in the order of limit per weight, so one pass finds the level.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    limits = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size").cast("double") * repeats)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "rank")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = limits.withColumns(
        {
            "_total": F.sum("source_size").over(every) * F.lit(float(share)),
            "_caps": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_rest": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        }
    )
    capped = level.withColumn("_full", (F.col("_total") - F.col("_caps")) / F.col("_rest") * F.col("_w") >= F.col("_cap"))
    open_w = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(every)
    taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0.0))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise((F.col("_total") - taken) / open_w * F.col("_w"))
    return capped.withColumn("target", target).select("source", "source_size", "rank", "target")


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas per (shard, source): rows add to the shards' even loads, columns to ``quotas``, both exactly."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    nodes = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while nodes:
        low, high, own = nodes.pop()
        if high - low == 1:
            out[low] = own
            continue
        middle = (low + high) // 2
        load = int(own.sum()) * (middle - low) // (high - low)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(own, load, method="marginals")
        nodes += [(low, middle, left), (middle, high, own - left)]
    return out


def _split_table(shards: int, seed: int):
    def split(quotas: pd.DataFrame) -> pd.DataFrame:
        quotas = quotas.sort_values("rank")
        per_shard = split_quotas(quotas["quota"].to_numpy(), shards, seed)
        ends = per_shard.cumsum(axis=0).T
        return pd.DataFrame({"rank": quotas["rank"].to_numpy(), "ends": [list(map(int, e)) for e in ends]})

    return split


def draw_blocks(docs: DataFrame, shards: int, seed: int, weights, share: float, repeats: int) -> DataFrame:
    """Per (source, block): source_size, target, and the shards that draw the block (one entry per draw).

    The block table has at most ``BLOCKS`` rows per source, the quota table one row per source.
    """
    blocks = docs.groupBy("source", "_block").agg(F.sum("size").alias("_words"))
    sizes = blocks.groupBy("source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights, share, repeats)
    known = blocks.join(targets.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    order = Window.partitionBy("rank").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "_block")), "_block")
    cut = known.withColumns(
        {
            "_passes": passes,
            "_place": F.row_number().over(order) - 1,
            "_before": F.coalesce(F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    ).withColumn("_part", F.col("_before") + F.col("_words") / 2 <= F.col("target") - F.col("_passes") * F.col("source_size"))
    cut = cut.withColumn("_part", F.col("_part") & (F.col("_words") > 0))
    quotas = cut.groupBy("rank").agg((F.max("_passes") * F.count("*") + F.sum(F.col("_part").cast("long"))).alias("quota"), F.count("*").alias("n_blocks"))
    ends = quotas.groupBy().applyInPandas(_split_table(shards, seed), "rank int, ends array<long>")
    ready = cut.join(quotas.select("rank", "n_blocks"), "rank").join(ends, "rank")
    # the draws of a block stand at place, place + n_blocks, ... of its source's list; a shard owns the places below its end
    draws = F.when(F.col("_passes") + F.col("_part").cast("long") > 0, F.sequence(F.lit(0), (F.col("_passes") + F.col("_part").cast("long") - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    shard = F.transform(draws, lambda d: F.size(F.filter("ends", lambda e: e <= d * F.col("n_blocks") + F.col("_place"))))
    return ready.select("source", "_block", "source_size", "target", shard.alias("shards"))


def shard_draws(drawn: DataFrame, shards: int) -> DataFrame:
    """One row with ``shard_draws``: the draws of every shard, as its blocks have them; counted over the block table."""
    counts = drawn.select(F.explode("shards").alias("_shard")).groupBy("_shard").agg(F.count("*").alias("_n"))
    by_shard = counts.agg(F.map_from_entries(F.collect_list(F.struct("_shard", "_n"))).alias("_n"))
    return by_shard.select(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.try_element_at("_n", i), F.lit(0))).alias("shard_draws"))


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 7, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per document: the columns ``doc_id, source, size, source_size, target, shards, taken, shard_draws``.

    ``shards`` lists the output shards that take the document, one entry per copy; ``taken`` is its words times its copies.
    ``shard_draws`` is the same in all rows: the number of block draws that each shard owns, equal up to the rounding of the tree.
    An empty table gives no rows; texts are only counted, so their length does not matter.
    A null text has size 0. Ids may be null or repeated: equal rows fall into one block. Null is a source, the last. Other columns
    are not read. A source's taken words miss its target by half of one block (1/1024 of the source, or one document) at most.
    """
    slim = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"))
    slim = slim.withColumn("_block", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "size")), 1, 3), 16, 10).cast("int"), F.lit(BLOCKS)))
    slim = checkpointed(slim)  # sizes are counted once; the texts are left behind
    drawn = checkpointed(draw_blocks(slim, shards, seed, weights, share, repeats))
    draws = shard_draws(drawn, shards).scalar()
    drawn = drawn.withColumnsRenamed({"source": "_of", "_block": "_of_block"})
    joined = slim.join(drawn, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_of_block")))
    return joined.select("doc_id", "source", "size", "source_size", "target", "shards", (F.col("size") * F.size("shards")).alias("taken"), draws.alias("shard_draws"))


def mixed_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 7, **kw) -> DataFrame:
    """The mix itself: the rows of ``docs`` once per draw, dealt by shard and shuffled locally. Columns as in ``docs``.

    Rows with equal id, source and size share their draws, so they are matched as such.
    """
    drawn = mix(docs, shards, seed, **kw).dropDuplicates(["doc_id", "source", "size"]).select("doc_id", "source", "size", "shards")
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), count_words(F.col("text")).alias("_size"))
    rows = packed.join(drawn, F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size")))
    copies = rows.select("_row", "_id", F.posexplode("shards").alias("_copy", "_shard"))
    key = F.xxhash64(F.lit(seed), "_id", "_copy", "_shard")
    return copies.repartition("_shard", F.pmod(key, F.lit(64))).sortWithinPartitions("_shard", key).select("_row.*")
