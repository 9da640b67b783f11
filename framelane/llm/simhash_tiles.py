"""SimHash near-duplicates by tiled exact comparison.

Texts become 64-bit fingerprints; equal ones are one class. Fingerprints fall into cells by the population counts of their two
halves. Cells (cut into tiles where they are large) are compared pairwise by exclusive-or and bit counts in numpy; pairs of cells, and
inside a pair parts of tiles, whose population counts differ beyond the radius are skipped: no link can lie there. So
the comparison is exact. Tasks send spanning links only; components follow from them.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from framelane.llm.components import connected_components, spanning
from framelane.llm.shared import checkpointed, slices

#: Fingerprints of a tile: 1 MB.
TILE = 131_072
#: Exclusive-ors at a time.
AT_ONCE = 2_000_000


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The fingerprint (signed) of a UTF-8 text: words cut at ASCII white space, A-Z lower-cased, shingles of ``width`` words.

    A text with fewer words has one shingle; without words the fingerprint is 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_bits = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, width: int = 3) -> Column:
    """The fingerprint as a long; null texts count as empty."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return slices(texts, lambda own: [fingerprint(t or b"", width) for t in own], pa.int64())

    return of(text.cast("binary"))


def _popcounts(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters, one row per fingerprint."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def close_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between fingerprints of two tiles (or of one, with ``right`` None) that differ in ``radius`` bits at most."""
    other = left if right is None else right
    found_u, found_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    counts, other_counts = _popcounts(left), _popcounts(other)
    parts, part_of = np.unique(counts, axis=0, return_inverse=True)
    part_of = part_of.reshape(-1)
    for k, part in enumerate(parts):
        mine = left[part_of == k]
        yours = other[np.abs(other_counts - part).sum(axis=1) <= radius]
        step = max(1, AT_ONCE // max(1, len(yours)))
        for at in range(0, len(mine) if len(yours) else 0, step):
            rows = mine[at : at + step]
            i, j = np.nonzero(np.bitwise_count(rows.view(np.uint64)[:, None] ^ yours.view(np.uint64)[None, :]) <= radius)
            u, v = rows[i], yours[j]
            u, v = spanning(u[u != v], v[u != v])
            found_u.append(u)
            found_v.append(v)
    return spanning(np.concatenate(found_u), np.concatenate(found_v))


def tile_links(prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links ``u, v`` that span all pairs of fingerprints (``fp``, distinct) within ``radius`` bits.

    The table of cells has at most 33 x 33 rows and its plan at most that times the neighbours within the radius.
    """
    low, high = F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF)), F.bit_count(F.shiftrightunsigned("fp", 32))
    placed = prints.select("fp", (low * 33 + high).cast("int").alias("cell"))
    cells = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    steps = [(a, b) for a, b in product(range(-radius, radius + 1), repeat=2) if abs(a) + abs(b) <= radius]
    near = F.filter(
        F.array(*[F.when((F.col("cell").cast("int") % 33 + b).between(0, 32), F.col("cell") + a * 33 + b) for a, b in steps]), lambda c: c.isNotNull()
    )
    plan = cells.select("cell", "tiles", F.explode(near).alias("other")).join(cells.select(F.col("cell").alias("other"), F.col("tiles").alias("other_tiles")), "other")
    sent = placed.join(F.broadcast(plan), "cell").select(  # bounded: see above
        "fp", "cell", "other", F.pmod(F.xxhash64("fp"), "tiles").cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)).alias("o")
    )
    mine, yours = F.struct(F.col("cell").alias("c"), F.col("t").alias("t")), F.struct(F.col("other").alias("c"), F.col("o").alias("t"))
    keyed = sent.select("fp", F.least(mine, yours).alias("a"), F.greatest(mine, yours).alias("b"), (mine > yours).alias("second"))

    def compare(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy()
        second = group.column("second").to_numpy()
        alone = group.column("a")[0] == group.column("b")[0]
        left, right = (fps, None) if alone else (fps[~second], fps[second])
        u, v = close_links(left, right, radius) if alone or (len(left) and len(right)) else (fps[:0], fps[:0])
        return pa.table({"u": u, "v": v})

    return keyed.groupBy("a", "b").applyInArrow(compare, "u long, v long")


def near_classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``fp, group`` for the distinct fingerprints of ``prints`` (``fp``) that link with another; others are not listed."""
    found = connected_components(tile_links(prints.select("fp").distinct(), radius))
    return found.select(F.col("node").alias("fp"), F.col("component").alias("group"))


def dedup(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` (smallest id of the linked documents) for every row.

    Null and empty texts have fingerprint 0, linked like others. Null ids take part but are never a component's id, unless it
    has no other. Repeated rows link like other equal texts; other columns are not read. The table of fingerprints, without the texts, is written once.
    """
    prints = checkpointed(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), width).alias("fp")))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    grouped = classes.join(near_classes(classes, radius), "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    firsts = grouped.groupBy("group").agg(F.min("first_id").alias("component_id"))
    of_class = checkpointed(grouped.join(firsts, "group").select("fp", "component_id"))
    return prints.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
