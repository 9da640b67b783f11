"""SimHash near-duplicates at a wide radius: 256-bit fingerprints, tiled exact comparison, exact similarity inside the groups.

For a similarity of 0.8 of five-word shingles 64 bits are too few: related and unrelated texts overlap. With 256 bits they are far
apart. The distinct fingerprints are dealt to tiles by population count and compared tile by tile with exclusive-or and bit
counts; tile pairs whose population counts differ beyond the radius are skipped. The groups that this links are then
compared exactly (Jaccard of shingle sets, again in tiles), and what is similar enough stays linked. Equal fingerprints
only make a group as well: texts are one class without a comparison where their shingle sets are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from framelane.llm.components import connected_components, spanning
from framelane.llm.rp_forest import tile_pairs
from framelane.llm.shared import checkpointed, give_back, slices
from framelane.operators.ordered import salted_join

#: 64-bit words of a fingerprint.
WORDS = 4
#: Differing bits up to which texts are compared exactly: texts whose shingle sets have a Jaccard similarity of 0.8 differ in 39 bits on average, with a deviation of 6.
RADIUS = 60
#: A table has some 32 tiles, each of so many fingerprints (32 bytes each) at least and at most; every fingerprint is sent to all tiles in reach.
TILES, LEAST_TILE, MOST_TILE = 32, 512, 1_000_000
#: Pairs of fingerprints at a time, so that they stay in the processor's cache.
BLOCK = 131_072
#: Texts of a tile of exact comparison, and shingles at a time.
EXACT_TILE, COLUMNS = 128, 4096

_SALTS = np.random.default_rng(5).integers(0, 2**64, WORDS, dtype=np.uint64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """A 64-bit hash per shingle of ``width`` lower-cased words, repeats included; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    starts = (ends - sizes)[: 1 - width].tolist()
    return np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts))


def wide_fingerprint(text: bytes, width: int) -> bytes:
    """``WORDS`` x 64 bits, each set where more than half of the distinct shingle hashes, mixed anew for each word, set it.

    Repeats count once, as in the similarity of shingle sets: a line repeated inside a text moves no bit by its number.
    """
    return _majority(np.unique(shingle_hashes(text, width)))


def _majority(hashes: np.ndarray) -> bytes:
    out = []
    for salt in _SALTS:
        h = (hashes ^ salt) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h), bitorder="little").tobytes())
    return b"".join(out)


def wide_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``u, v`` that span all pairs of ``prints`` (``node`` long, ``fp`` binary, distinct) within ``radius`` bits.

    The driver sees the number of fingerprints per population count: 64 * WORDS + 1 numbers at most.
    """
    counted = _with_popcount(prints)
    sizes = {r.pc: r.n for r in counted.groupBy("pc").agg(F.count("*").alias("n")).collect()}
    tile = min(MOST_TILE, max(LEAST_TILE, sum(sizes.values()) // TILES))
    bands: list[list[int]] = []  # first and last population count, fingerprints
    for pc in sorted(sizes):
        if bands and bands[-1][2] + sizes[pc] <= tile:
            bands[-1][1:] = [pc, bands[-1][2] + sizes[pc]]
        else:
            bands.append([pc, pc, sizes[pc]])
    parts = [-(-n // tile) for _, _, n in bands]
    first = np.cumsum([0, *parts])
    reach = [[t for j, (lo, hi, _) in enumerate(bands) if lo - radius <= b[1] and hi + radius >= b[0] for t in range(first[j], first[j + 1])] for b in bands]
    if not bands:
        return prints.select(F.col("node").alias("u"), F.col("node").alias("v"))
    rows = ", ".join(f"({pc}, {first[k]}, {parts[k]}, array({', '.join(map(str, reach[k]))}))" for k, b in enumerate(bands) for pc in range(b[0], b[1] + 1))
    plan = prints.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(pc, first, parts, others)")
    own = (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int")
    sent = counted.join(F.broadcast(plan), "pc").select("node", "fp", own.alias("own"), F.explode("others").alias("other"))  # one row per population count
    keyed = sent.select("node", "fp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own")

    def compare(group: pa.Table) -> pa.Table:
        node, tile_of = group.column("node").to_numpy(), group.column("own").to_numpy()
        fps = np.frombuffer(b"".join(group.column("fp").to_pylist()), np.uint64).reshape(len(group), -1)
        left, right = (np.flatnonzero(tile_of == group.column(x)[0].as_py()) for x in "ab")
        us, vs = [node[:0]], [node[:0]]
        words = [np.ascontiguousarray(fps[right, k]) for k in range(fps.shape[1])]
        step = max(1, BLOCK // max(1, len(right)))
        differ, bits = np.empty((step, len(right)), np.uint64), np.empty((2, step, len(right)), np.uint8)
        for at in range(0, len(left) if len(right) else 0, step):
            mine = left[at : at + step]
            n = len(mine)
            for k, word in enumerate(words):
                np.bitwise_xor(fps[mine, k][:, None], word[None, :], out=differ[:n])
                np.bitwise_count(differ[:n], out=bits[min(k, 1), :n])
                if k:
                    bits[0, :n] += bits[1, :n]  # may wrap at 256, so what is found is counted again
            i, j = np.nonzero(bits[0, :n] <= radius)
            if len(i):
                a, b = mine[i], right[j]
                near = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64) <= radius
                u, v = spanning(node[a[near]], node[b[near]])
                us.append(u)
                vs.append(v)
        u, v = spanning(np.concatenate(us), np.concatenate(vs))
        give_back()
        return pa.table({"u": u, "v": v})

    return keyed.groupBy("a", "b").applyInArrow(compare, "u long, v long")


def _with_popcount(prints: DataFrame) -> DataFrame:
    @F.arrow_udf("int")
    def count(fps: pa.Array) -> pa.Array:
        raw = np.frombuffer(b"".join(fps.to_pylist()), np.uint64).reshape(len(fps), -1)
        return pa.array(np.bitwise_count(raw).sum(axis=1).astype(np.int32))

    return prints.select("node", "fp", count("fp").alias("pc"))


def similar_links(members: DataFrame, width: int, least: float) -> DataFrame:
    """Links ``u, v`` that span all pairs of a group's texts (``group``, ``node``, ``text``) whose shingle sets have a Jaccard similarity of ``least``."""

    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        return slices(texts, lambda own: [np.unique(shingle_hashes(t or b"", width)).tobytes() for t in own], pa.binary())

    def compare(group: pa.Table) -> pa.Table:
        node, own = group.column("node").to_numpy(), group.column("own").to_numpy()
        shingles = [np.frombuffer(b, np.uint64) for b in group.column("set").to_pylist()]
        sizes = np.array([len(s) for s in shingles])
        flat, owner = np.concatenate(shingles), np.repeat(np.arange(len(shingles)), sizes)
        values, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[place] > 1
        place, owner = place[shared], owner[shared]
        _, place = np.unique(place, return_inverse=True)
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        common = np.zeros((len(node), len(node)), np.float32)
        for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
            a, b = np.searchsorted(place, [at, at + COLUMNS])
            block = np.zeros((len(node), COLUMNS), np.float32)
            block[owner[a:b], place[a:b] - at] = 1
            common += block @ block.T
        similar = common >= least * (sizes[:, None] + sizes[None, :] - common) - 1e-6
        similar &= (own[:, None] == group.column("a")[0].as_py()) & (own[None, :] == group.column("b")[0].as_py())
        i, j = np.nonzero(similar)
        u, v = spanning(node[i[i != j]], node[j[i != j]])
        give_back()
        return pa.table({"u": u, "v": v})

    packed = checkpointed(members.select("group", "node", sets("text").alias("set")))
    return tile_pairs(packed, ["group"], EXACT_TILE).groupBy("group", "a", "b").applyInArrow(compare, "u long, v long")


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with their columns, one of each group of near-duplicates: the smallest id.

    Texts with equal shingle sets are one document, null and empty ones among them. Null ids come last; ties of an id go by a hash of
    the text, and rows equal in id and text count once.
    """

    def print_and_digest(text: bytes) -> bytes:
        hashes = np.unique(shingle_hashes(text, width))
        return _majority(hashes) + hashlib.sha256(hashes.tobytes()).digest()

    @F.arrow_udf("binary")
    def print_of(texts: pa.Array) -> pa.Array:
        return slices(texts, lambda own: [print_and_digest(t or b"") for t in own], pa.binary())

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    doc, tie = F.coalesce("doc_id", F.lit(2**63 - 1)).cast("long"), F.xxhash64(text)
    prints = checkpointed(docs.select(doc.alias("doc"), tie.alias("tie"), print_of(text).alias("print")))
    firsts = prints.groupBy("print").agg(F.min(F.struct("doc", "tie")).alias("first"))
    classes = checkpointed(firsts.select(F.substring("print", 1, 8 * WORDS).alias("fp"), "first", F.monotonically_increasing_id().alias("node")))
    ends = checkpointed(classes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")))  # one class per fingerprint
    loose = connected_components(wide_links(ends.select("node", "fp"), radius))
    group = F.coalesce("component", "node").alias("group")
    grouped = checkpointed(ends.join(loose, "node", "left").where(F.col("component").isNotNull() | (F.col("n") > 1)).select("fp", group))
    named = checkpointed(salted_join(classes, grouped, ["fp"]).select("node", "group", F.col("first.doc").alias("_doc"), F.col("first.tie").alias("_tie")))
    texts = docs.select(doc.alias("_doc"), tie.alias("_tie"), text.alias("text"))
    members = texts.join(named, ["_doc", "_tie"]).select("group", "node", "text").dropDuplicates(["node"])
    groups = connected_components(similar_links(members, width, least))
    heads = classes.join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("head"))
    kept = checkpointed(heads.select(F.col("head.doc").alias("_doc"), F.col("head.tie").alias("_tie")))
    packed = docs.select(F.struct("*").alias("_row"), doc.alias("_doc"), tie.alias("_tie"))
    return packed.join(kept, ["_doc", "_tie"], "left_semi").dropDuplicates(["_doc", "_tie"]).select("_row.*")
