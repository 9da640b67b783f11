"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits the vectors at medians of random projections; vectors near a split go to both sides (spill). A node splits on
the direction, out of a few, that spills least; a node that every direction would mostly spill is dense and stays a leaf.
Trees are fitted on a bounded sample and every vector is sent down every tree. Vectors are compared within leaves (large
leaves in tiles, all pairs of tiles), verified links are united over all trees, and an exact tiled count inside the united
groups gives each vector's number of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framelane.llm.components import connected_components, spanning
from framelane.llm.shared import checkpointed
from framelane.operators.ordered import salted_join

TREES = 5
#: Vectors to fit the trees on, chosen by a hash (this many to twice as many): they meet on the driver (10 to 20 MB at 64 dimensions).
SAMPLE = 20_000
#: Vectors a leaf should hold, over all labels.
LEAF = 8192
#: Vectors of a comparison tile.
TILE = 2048


class Forest:
    """Trees as nested tuples (direction, threshold, left, right); a leaf is its number."""

    def __init__(self, sample: np.ndarray, least: float, trees: int, leaf_share: float, seed: int = 1, directions: int = 8):
        self.dims = sample.shape[1]
        reach = np.sqrt(2 - 2 * least)  # the largest distance of linked unit vectors
        self.margin = 0.65 * reach / np.sqrt(max(1, self.dims))
        self.leaf_size = max(16, leaf_share * len(sample))
        self.directions = directions
        self.trees = []
        for t in range(trees):
            self.leaves = 0
            self.trees.append(self._grow(sample, np.random.default_rng([seed, t]), 0))

    def _grow(self, rows: np.ndarray, rng: np.random.Generator, depth: int):
        best = None
        if len(rows) > self.leaf_size and depth < 40:
            ways = rng.standard_normal((self.directions, self.dims))
            ways /= np.linalg.norm(ways, axis=1, keepdims=True)
            places = rows @ ways.T
            middles = np.median(places, axis=0)
            spilled = (np.abs(places - middles) <= self.margin).mean(axis=0)
            k = int(np.argmin(spilled))
            if spilled[k] <= 0.5:
                best = ways[k], float(middles[k]), places[:, k]
        if best is None:
            self.leaves += 1
            return self.leaves - 1
        way, middle, place = best
        left = self._grow(rows[place <= middle + self.margin], rng, depth + 1)
        return way, middle, left, self._grow(rows[place >= middle - self.margin], rng, depth + 1)

    def leaves_of(self, tree: int, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of its rows) for unit vectors; a row can be in several leaves."""
        todo = [(self.trees[tree], np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            way, middle, left, right = node
            place = rows[at] @ way
            todo += [(left, at[place <= middle + self.margin]), (right, at[place >= middle - self.margin])]


def unit_rows(lists: list[np.ndarray], dims: int) -> np.ndarray:
    """Unit vectors in double precision, cut or filled with zeros to ``dims``."""
    out = np.zeros((len(lists), dims))
    for i, x in enumerate(lists):
        full = x.astype(np.float64)
        out[i, : len(full)] = (full / np.linalg.norm(full))[:dims]
    return out


def _vectors(blobs: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision from float blobs of one length."""
    raw = np.frombuffer(b"".join(blobs.to_pylist()), "<f8").reshape(len(blobs), -1)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """Distinct usable (label, embedding): ``node`` (unique long), ``label``, ``embedding``, ``first_id``, ``n`` (rows)."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = e.isNotNull() & F.col("label").isNotNull() & ~bad & F.exists(e, lambda x: x != 0)
    classes = vectors.filter(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    return checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))


def as_blob(classes: DataFrame) -> DataFrame:
    """Adds ``vec`` (double blob) and ``dims``."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        ends, flat = lists.offsets.to_numpy(), np.asarray(lists.values.to_numpy(zero_copy_only=False), "<f8")
        return pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())

    return classes.withColumn("vec", pack(F.col("embedding").cast("array<double>"))).withColumn("dims", F.size("embedding"))


def tile_pairs(rows: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Every row to the pairs of tiles of its group that its own tile belongs to: adds ``a``, ``b`` (tiles, a <= b) and ``own`` (its tile).

    Groups up to ``tile`` rows have one pair; larger ones are dealt to tiles by a hash of ``node``. Keys must not be null.
    No group meets in one task on the way: the number of its tiles is joined under salts.
    """
    sizes = checkpointed(rows.groupBy(*keys).agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles")))
    dealt = salted_join(rows, sizes, keys).withColumn("own", F.pmod(F.xxhash64("node"), "_tiles").cast("int"))
    sent = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return sent.withColumn("a", F.least("own", "_other")).withColumn("b", F.greatest("own", "_other")).drop("_other", "_tiles")


def _hits(group: pa.Table, least: float, step: int = 512):
    """The two sides of a tile pair, and per block of rows of the first side the matrix of links."""
    vec, own = _vectors(group.column("vec")), group.column("own").to_numpy()
    a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
    left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
    for at in range(0, len(left), step):
        mine = left[at : at + step]
        yield mine, right, (vec[mine] @ vec[right].T >= least) & (mine[:, None] != right[None, :]), a == b


def forest_links(classes: DataFrame, forest: Forest, least: float, tile: int = TILE) -> DataFrame:
    """Spanning links ``u, v`` of every leaf of every tree between vectors of equal label and length."""
    trees = len(forest.trees)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unit_rows([np.frombuffer(v, "<f8") for v in batch.column("vec").to_pylist()], forest.dims)
            for t in range(trees):
                for leaf, at in forest.leaves_of(t, rows):
                    out = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), leaf, np.int32))], [*out.schema.names, "tree", "leaf"])

    plain = as_blob(classes).select("node", F.col("label").cast("long").alias("label"), "dims", "vec")
    placed = plain.mapInArrow(index, "node long, label long, dims int, vec binary, tree int, leaf int")
    keys = ["tree", "leaf", "label", "dims"]

    def compare(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        us, vs = [node[:0]], [node[:0]]
        for mine, right, hit, _ in _hits(group, least):
            i, j = np.nonzero(hit)
            u, v = spanning(node[mine[i]], node[right[j]])
            us.append(u)
            vs.append(v)
        u, v = spanning(np.concatenate(us), np.concatenate(vs))
        return pa.table({"u": u, "v": v})

    return tile_pairs(placed, keys, tile).groupBy(*keys, "a", "b").applyInArrow(compare, "u long, v long")


def count_links(members: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """``node, links``: rows of other classes within reach, counted exactly inside each component (``component, label, node, n, dims, vec``)."""

    def count(group: pa.Table) -> pa.Table:
        node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
        total = np.zeros(len(node), np.int64)
        for mine, right, hit, alone in _hits(group, least):
            total[mine] += hit @ n[right]
            if not alone:
                total[right] += n[mine] @ hit
        return pa.table({"node": node, "links": total})

    pairs = tile_pairs(members, ["component", "dims"], tile)
    return pairs.groupBy("component", "dims", "a", "b").applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def dedup(vectors: DataFrame, least: float = 0.93, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id``, ``embedding``, ``label``; others are not read).

    Rows with a null label, or a vector that is null, empty, zero or not finite, link with nothing. Equal vectors of a label are one
    class and count each other. Vectors of different lengths do not link. Null ids take part but name no component; where a
    component has no id, ``kept`` is false. An empty table gives an empty table.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    classes = vector_classes(rows)
    n, dims = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    picked = classes.where(F.pmod(F.xxhash64("embedding", "label"), F.lit(max(1, n // sample))) == 0)
    chosen = sorted(bytes(r.vec) for r in as_blob(picked).select("vec").collect())  # one in n / sample: less than twice ``sample``
    if not chosen:
        chosen = [bytes(as_blob(classes.limit(1)).first().vec)]
    forest = Forest(unit_rows([np.frombuffer(v, "<f8") for v in chosen], dims), least, trees, leaf / n)
    component = connected_components(forest_links(classes, forest, least))
    linked = as_blob(classes.join(component, "node")).select("component", "node", "first_id", "n", "dims", "vec")
    counts = count_links(linked.drop("first_id"), least)
    heads = linked.groupBy("component").agg(F.min("first_id").alias("head"))
    known = linked.select("node", "component").join(heads, "component").join(counts, "node", "left").select("node", "head", "links")
    of_class = checkpointed(
        classes.join(known, "node", "left").select(
            "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("head", "first_id").alias("_head"), F.lit(True).alias("_known")
        )
    )
    out = rows.join(of_class, ["label", "embedding"], "left")
    component_id = F.when(F.col("_known"), F.col("_head")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept")
    )
