"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if it lies in a ``length``-byte string that starts earlier in the corpus too (smaller document, or earlier in the
same one). With LPF(p), the longest match of the suffix at p with a suffix that starts earlier, this is LPF(p) >= ``length`` for
some p at most ``length - 1`` bytes before. Among suffixes in order, the earlier one with the longest match is the nearest
before or the nearest after that starts earlier (the previous and the next smaller position), and the match is the smallest
common prefix of neighbours on the way. Suffixes are compared over ``length`` bytes, so LPF is cut there.

Spark brings together what can match. Every window has a key: the smallest hash of its ``GRAM``-byte grams. Equal windows have
equal keys, and neighbouring windows mostly share theirs, so a text is a list of runs of windows with one key. Keys are
counted over the corpus; runs whose key occurs once are done. The others go, with their bytes, to the bucket of their
key, where their suffixes are put in order and get their LPF. Runs with a very common key go window by window, and in
rounds: a bucket takes a window's copies from ``fan`` batches only and passes the earliest on to the next round, which takes
them from ``fan`` times as many. So no bucket grows with the corpus, whatever repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from framelane.llm.shared import checkpointed

GRAM = 32
#: Bytes of text in a batch (one group of a task), and in a chunk (one round of array work).
BATCH, CHUNK = 4_000_000, 400_000
#: Runs of one key that may meet in a bucket.
HOT = 2048
#: Batches (or groups of batches) whose copies of one window may meet in a bucket.
FAN = 256
#: Kinds of runs: to be searched; single windows with a very common key, searched in rounds; repeats.
PLAIN, COMMON, DONE = 0, 1, 2
#: Windows sorted at a time.
SORTED = 100_000

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(buf: np.ndarray, length: int, keys: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a buffer's grams, and per window start its key (smallest gram hash) and the hash of the whole window."""
    grown, size, level, gram = _BYTE[buf], 1, 0, None
    while 2 * size <= length:
        grown = grown[:-size] * _ODD[level % 8] + grown[size:]
        size, level = 2 * size, level + 1
        if size == GRAM:
            gram = grown
    whole = grown
    if size < length:
        rest = length - size
        whole = grown[: len(grown) - rest] * _ODD[7] + grown[rest:]
    if not keys:
        return whole[:0], whole[:0], _mixed(whole)
    gram = _mixed(gram)
    low, width, wanted = gram, 1, length - GRAM + 1
    while 2 * width <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < wanted:
        low = np.minimum(low[: len(low) - (wanted - width)], low[wanted - width :])
    return gram, low, _mixed(whole)


class Chunk:
    """Some texts end to end, and the runs of equal keys of their windows; no window crosses texts."""

    def __init__(self, texts: list[bytes], length: int):
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.cumsum(sizes) - sizes
        self.gram, keys, self.whole = window_hashes(self.buf, length)
        self.wide = length - GRAM + 1
        valid = np.zeros(len(keys), bool)
        for a, n in zip(self.at.tolist(), sizes.tolist()):
            valid[a : max(a, a + n - length + 1)] = True
        turn = np.ones(len(keys) + 1, bool)
        if len(keys):
            turn[1:-1] = (keys[1:] != keys[:-1]) | (valid[1:] != valid[:-1])
            turn[np.minimum(self.at, len(keys))] = True
        edges = np.flatnonzero(turn)
        first, last = edges[:-1], edges[1:]
        inside = valid[first] if len(first) else np.zeros(0, bool)
        self.start, self.count = first[inside], (last - first)[inside]
        self.key = keys[self.start]

    def alone(self) -> np.ndarray:
        """Is the key of a run the hash of one gram in it only? Then no two windows of the run are equal."""
        span = self.count + self.wide - 1
        low = np.cumsum(span) - span
        grams = np.repeat(self.start - low, span) + np.arange(span.sum())
        same = self.gram[grams] == np.repeat(self.key, span)
        return np.add.reduceat(same, low, dtype=np.int64) < 2 if len(span) else np.zeros(0, bool)


def chunks(texts: list[bytes], length: int) -> Iterator[tuple[int, Chunk]]:
    """Chunks of the texts that have windows; texts that are too short make none by themselves."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            if size >= length:
                yield low, Chunk(texts[low : i + 1], length)
            low, size = i + 1, 0


def _split(order_of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, its places) of an integer array."""
    order = np.argsort(order_of, kind="stable")
    values, first = np.unique(order_of[order], return_index=True)
    for value, places in zip(values.tolist(), np.split(order, first[1:])):
        yield value, places


def _cat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _blobs(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in column.to_pylist()]


def _texts(given: pa.Table, notes: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The batch's documents that are the first of their text, in order: bytes, ids and ties; repeated rows once."""
    rank = {}
    for doc, tie, first in zip(notes.column("doc").to_pylist(), notes.column("tie").to_pylist(), notes.column("first").to_pylist()):
        if first:
            rank[doc, tie] = True
    seen = {}
    for doc, tie, text in zip(given.column("doc").to_pylist(), given.column("tie").to_pylist(), given.column("text").to_pylist()):
        if (doc, tie) in rank:
            seen[doc, tie] = text
    ordered = sorted(seen)
    ids = np.array(ordered, np.int64).reshape(-1, 2)
    return [seen[k] for k in ordered], ids[:, 0], ids[:, 1]


KEYS = "bucket long, batch long, keys binary, counts binary"
NOTES = "batch long, doc long, tie long, first boolean, keys binary, hot binary, starts binary, counts binary, docs binary, ties binary"
RUNS = "bucket long, kind long, batches binary, docs binary, ties binary, starts binary, counts binary, bytes binary"
#: The number columns of runs, as they are packed.
PACKED = {"batches": "<i8", "docs": "<i8", "ties": "<i8", "starts": "<u4", "counts": "<u4"}


def count_keys(length: int, buckets: int):
    """Batch of texts -> per bucket the batch's distinct keys and the number of their runs; runs that may repeat in themselves count twice."""

    def run(given: pa.Table, notes: pa.Table) -> pa.Table:
        texts, _, _ = _texts(given, notes)
        found = [(c.key, 2 - c.alone()) for _, c in chunks(texts, length)]
        keys, place = np.unique(_cat([k for k, _ in found], np.uint64), return_inverse=True)
        counts = np.bincount(place, _cat([n for _, n in found], np.int64), len(keys))
        counts = np.minimum(counts, 65535).astype("<u2")
        batch = given.column("batch")[0].as_py() if len(given) else 0
        rows = [(b, batch, keys[at].tobytes(), counts[at].tobytes()) for b, at in _split((keys % np.uint64(buckets)).astype(np.int64))]
        return _table(rows, KEYS)

    return run


def common_keys(hot: int):
    """Bucket of keys -> per batch the keys that occur twice or more in the corpus, and which of them are very common."""

    def run(group: pa.Table) -> pa.Table:
        keys = _blobs(group.column("keys"), "<u8")
        owner = np.repeat(np.array(group.column("batch").to_pylist(), np.int64), [len(k) for k in keys])
        flat, counts = _cat(keys, np.uint64), _cat(_blobs(group.column("counts"), "<u2"), np.uint16).astype(np.int64)
        values, place = np.unique(flat, return_inverse=True)
        totals = np.bincount(place, counts, len(values))[place]
        kept = np.flatnonzero(totals >= 2)
        rows = []
        for batch, at in _split(owner[kept]):
            own = kept[at]
            rows.append((batch, None, None, None, flat[own].tobytes(), (totals[own] > hot).astype(np.uint8).tobytes(), None, None, None, None))
        return _table(rows, NOTES)

    return run


def _packed(runs: dict[str, np.ndarray], at) -> list[bytes]:
    return [runs[n][at].astype(kind).tobytes() for n, kind in PACKED.items()]


def common_bucket(hashes: np.ndarray, batches: np.ndarray, step: int, buckets: int) -> np.ndarray:
    """Where single windows meet: by their hash and by the group of ``step`` batches they come from."""
    return (_mixed(hashes ^ _mixed((batches // step).astype(np.uint64) + np.uint64(1))) % np.uint64(buckets)).astype(np.int64)


def send_runs(length: int, buckets: int, step: int):
    """Batch of texts and its common keys -> runs by bucket; repeats found on the way come as finished runs."""

    def run(given: pa.Table, notes: pa.Table) -> pa.Table:
        texts, docs, ties = _texts(given, notes)
        answered = notes.filter(pa.compute.is_valid(notes.column("keys")))
        keys = _cat(_blobs(answered.column("keys"), "<u8"), np.uint64)
        order = np.argsort(keys)
        keys, hot = keys[order], _cat(_blobs(answered.column("hot"), np.uint8), np.uint8)[order]
        batch = given.column("batch")[0].as_py() if len(given) else 0
        parts: dict[int, dict[str, list]] = {k: {n: [] for n in ("bucket", "bytes", *PACKED)} for k in (PLAIN, COMMON, DONE)}
        seen: set[bytes] = set()

        def put(kind, base, c, start, count, bucket, pieces):
            to, text = parts[kind], np.searchsorted(c.at, start, side="right") - 1
            values = (np.full(len(start), batch), docs[base + text], ties[base + text], start - c.at[text], np.broadcast_to(count, len(start)))
            for name, value in zip(PACKED, values):
                to[name].append(value)
            to["bucket"].append(np.broadcast_to(bucket, len(start)).astype(np.int64))
            to["bytes"] += pieces

        for base, c in chunks(texts, length) if len(keys) else ():
            place = np.minimum(np.searchsorted(keys, c.key), len(keys) - 1)
            common = keys[place] == c.key
            plain, very = np.flatnonzero(common & (hot[place] == 0)), np.flatnonzero(common & (hot[place] == 1))
            raw = c.buf.tobytes()
            pieces = [raw[a : a + n + length - 1] for a, n in zip(c.start[plain].tolist(), c.count[plain].tolist())]
            fresh = np.fromiter((not (p in seen or seen.add(p)) for p in pieces), bool, len(pieces))
            again, plain = plain[~fresh], plain[fresh]
            put(PLAIN, base, c, c.start[plain], c.count[plain], c.key[plain] % np.uint64(buckets), [p for p, f in zip(pieces, fresh.tolist()) if f])
            put(DONE, base, c, c.start[again], c.count[again], batch % buckets, [])
            if len(very):
                n = c.count[very]
                windows = np.repeat(c.start[very] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                _, first, of = np.unique(c.whole[windows], return_index=True, return_inverse=True)
                view = np.lib.stride_tricks.sliding_window_view(c.buf, length)
                kept = np.zeros(len(windows), bool)
                kept[first] = True
                for low in range(0, len(windows), SORTED):  # another window under the same hash goes on by itself
                    some = slice(low, low + SORTED)
                    kept[some] |= (view[windows[some]] != view[windows[first[of[some]]]]).any(axis=1)
                own = windows[kept]
                put(COMMON, base, c, own, 1, common_bucket(c.whole[own], np.full(len(own), batch), step, buckets), [raw[a : a + length] for a in own.tolist()])
                gone = windows[~kept]
                first = np.flatnonzero(np.diff(gone, prepend=-2) != 1)  # neighbouring windows of a text are one run
                put(DONE, base, c, gone[first], np.diff(first, append=len(gone)), batch % buckets, [])
        rows = []
        for kind, to in parts.items():
            flat = {n: _cat(to[n], np.int64) for n in PACKED}
            for bucket, at in _split(_cat(to["bucket"], np.int64)):
                rows.append((bucket, kind, *_packed(flat, at), b"".join([to["bytes"][i] for i in at.tolist()]) if to["bytes"] else b""))
        return _table(rows, RUNS)

    return run


def _earlier_match(starts: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Per suffix, in suffix order, its match with the nearest one before that starts earlier; 0 if there is none.

    ``prefix`` holds the bytes in common with the suffix just before. Least starts and prefixes of 1, 2, 4, ... suffixes are
    tabled, and each suffix steps back over the longest stretches that start later.
    """
    lows, shared, width = [starts], [prefix], 1
    while width < len(starts):
        low, common = lows[-1].copy(), shared[-1].copy()
        np.minimum(lows[-1][width:], lows[-1][:-width], out=low[width:])
        np.minimum(shared[-1][width:], shared[-1][:-width], out=common[width:])
        lows.append(low)
        shared.append(common)
        width *= 2
    at, match = np.arange(len(starts)) - 1, prefix.copy()
    for level in range(len(lows) - 1, -1, -1):
        step = np.flatnonzero((at >= 0) & (lows[level][np.maximum(at, 0)] > starts))
        match[step] = np.minimum(match[step], shared[level][at[step]])
        at[step] -= 1 << level
    return np.where(at >= 0, match, 0)


def longest_previous_factors(starts: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """LPF of suffixes given in suffix order: the longer match with the previous and the next smaller of ``starts`` (all different).

    ``prefix`` as in ``_earlier_match``, its first entry 0.
    """
    turned = np.concatenate([prefix[:1] * 0, prefix[:0:-1]])
    return np.maximum(_earlier_match(starts, prefix), _earlier_match(starts[::-1], turned)[::-1])


def repeated_windows(windows: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Which suffixes (rows of ``length`` bytes) have LPF >= ``length``; ``earlier`` ranks their positions."""
    order = np.argsort(earlier, kind="stable")
    text = np.ascontiguousarray(windows[order])
    suffixes = np.argsort(text.view(f"S{text.shape[1]}").reshape(-1), kind="stable")
    ranked = text[suffixes]
    prefix = np.zeros(len(windows), np.int32)
    differ = ranked[1:] != ranked[:-1]
    prefix[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])
    repeat = np.zeros(len(windows), bool)
    repeat[order[suffixes]] = longest_previous_factors(suffixes, prefix) >= text.shape[1]
    return repeat


def _search(group: pa.Table, length: int, buckets: int, step: int | None) -> tuple[dict[str, np.ndarray], list[tuple]]:
    """Bucket of runs -> its repeats as finished runs, and rows with the common windows that stay, for the next round (``step``)."""
    cut = {n: _blobs(group.column(n), k) for n, k in PACKED.items()}
    kind = np.repeat(np.array(group.column("kind").to_pylist(), np.int64), [len(d) for d in cut["docs"]])
    runs = {n: _cat(parts, np.int64).astype(np.int64) for n, parts in cut.items()}
    done = [{n: v[kind == DONE] for n, v in runs.items()}]
    runs, kind = {n: v[kind != DONE] for n, v in runs.items()}, kind[kind != DONE]
    count, passed = runs["counts"], []
    if len(count):
        buf = np.frombuffer(b"".join(group.column("bytes").to_pylist()), np.uint8)
        sizes = count + length - 1
        at = np.cumsum(sizes) - sizes
        run_of = np.repeat(np.arange(len(count)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = at[run_of] + inside
        whole = np.concatenate([window_hashes(buf[a : a + CHUNK + length - 1], length, keys=False)[2][:CHUNK] for a in range(0, max(1, len(buf) - length + 1), CHUNK)])[place]
        rank = np.empty(len(count), np.int64)
        rank[np.lexsort((runs["starts"], runs["ties"], runs["docs"]))] = np.arange(len(count))
        hit = np.zeros(len(place), bool)
        view = np.lib.stride_tricks.sliding_window_view(buf, length)
        order = np.argsort(whole, kind="stable")
        sorted_hash = whole[order]
        twin = np.zeros(len(order), bool)
        twin[1:] = sorted_hash[1:] == sorted_hash[:-1]
        twin[:-1] |= twin[1:]
        order = order[twin]  # a suffix whose hash is alone has LPF < length
        ends = np.flatnonzero(np.diff(whole[order])) + 1
        low = 0
        while low < len(order):
            after = ends[np.searchsorted(ends, low + SORTED) :]  # equal hashes stay together
            high = int(after[0]) if len(after) else len(order)
            own = order[low:high]
            hit[own] = repeated_windows(view[place[own]], _position(rank, run_of[own], inside[own]))
            low = high
        own = np.flatnonzero(hit)
        if len(own):
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1] + 1) | (run_of[own[1:]] != run_of[own[:-1]])
            first = own[new]
            last = own[np.append(np.flatnonzero(new)[1:] - 1, len(own) - 1)]
            found = {n: v[run_of[first]] for n, v in runs.items()}
            done.append(found | {"starts": found["starts"] + inside[first], "counts": inside[last] - inside[first] + 1})
        if step is not None:
            stay = np.flatnonzero((kind[run_of] == COMMON) & ~hit)
            r = run_of[stay]
            for bucket, of in _split(common_bucket(whole[stay], runs["batches"][r], step, buckets)):
                passed.append((bucket, COMMON, *_packed(runs, r[of]), view[place[stay[of]]].tobytes()))
    return {n: np.concatenate([d[n] for d in done]) for n in PACKED}, passed


def thin_common(length: int, buckets: int, step: int):
    """Bucket of runs -> its repeats, finished, and for the next round the earliest of every common window."""

    def run(group: pa.Table) -> pa.Table:
        done, rows = _search(group, length, buckets, step)
        if len(done["docs"]):
            rows.append((group.column("bucket")[0].as_py(), DONE, *_packed(done, slice(None)), b""))
        return _table(rows, RUNS)

    return run


def find_repeats(length: int, buckets: int):
    """Bucket of runs in the last round -> per batch the repeats."""

    def run(group: pa.Table) -> pa.Table:
        done, _ = _search(group, length, buckets, None)
        rows = []
        for batch, at in _split(done["batches"]):
            _, docs, ties, starts, counts = _packed(done, at)
            rows.append((batch, None, None, None, None, None, starts, counts, docs, ties))
        return _table(rows, NOTES)

    return run


def _position(rank: np.ndarray, run_of: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Order of window starts: runs do not overlap in starts, so by run, then inside it."""
    return rank[run_of] * (int(inside.max()) + 1 if len(inside) else 1) + inside


def cut_texts(length: int):
    """Batch of texts and their ranges -> the kept bytes and the counts, a row per row of the batch."""

    def run(given: pa.Table, notes: pa.Table) -> pa.Table:
        first, ranges = {}, {}
        for note in notes.select(["doc", "tie", "first"]).to_pylist():
            if note["doc"] is not None:
                first[note["doc"], note["tie"]] = note["first"]
        found = notes.filter(pa.compute.is_valid(notes.column("starts")))
        for docs, ties, starts, counts in zip(*[_blobs(found.column(n), PACKED[n]) for n in ("docs", "ties", "starts", "counts")]):
            for d, t, a, n in zip(docs.tolist(), ties.tolist(), starts.tolist(), counts.tolist()):
                ranges.setdefault((d, t), []).append((a, a + n + length - 1))
        rows = []
        for doc, tie, doc_id, text in zip(*[given.column(n).to_pylist() for n in ("doc", "tie", "doc_id", "text")]):
            if first.get((doc, tie), True):
                spans = merge(ranges.get((doc, tie), []))
            else:  # a copy of an earlier text
                spans = [(0, len(text))] if len(text) >= length else []
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rows.append((doc_id, len(text), sum(b - a for a, b in spans), len(spans), b"".join(kept)))
        return _table(rows, CUT)

    return run


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(list(values), _ARROW[kind]) for (name, kind), values in zip(fields, columns)})


def round_steps(batches: int, fan: int) -> list[int]:
    """Batches whose copies of a common window meet in a bucket, by round: two rounds or more, the last with all batches."""
    rounds = 2
    while fan**rounds < batches:
        rounds += 1
    width = 1
    while width**rounds < batches:
        width += 1
    return [width**r for r in range(1, rounds)] + [max(batches, 1)]


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH, hot: int = HOT, fan: int = FAN) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) for every row of ``docs``.

    Null texts count as empty. Null ids come last in order; different texts of one id come in the order of a hash; rows equal in
    id and text are one document, with equal results. Later copies of a whole text need no search: they go whole if they are
    long enough. Texts are shuffled once, to batches by id, and read by each of the three steps from that shuffle. An empty table
    gives no rows; a very long text is a batch of its own, handled in chunks of whole texts.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")

    def keyed(*more):  # built anew for each use: Spark mixes up the two sides of a cogroup that share columns
        text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
        doc = F.coalesce(F.col(id_col), F.lit(2**63 - 1)).cast("long")
        return docs.select(F.col(id_col).alias("doc_id"), doc.alias("doc"), text.alias("text"), F.xxhash64(text).alias("tie")).select("doc", "tie", *more)

    light = checkpointed(keyed(F.sha2("text", 256).alias("_sha"), F.octet_length("text").cast("long").alias("_size")))
    firsts = checkpointed(light.groupBy("_sha").agg(F.min("doc").alias("_first")))
    total = light.agg(F.sum("_size")).first()[0] or 0
    batches = max(1, -(-total // batch_bytes))
    batch = F.pmod(F.xxhash64("doc", "tie"), F.lit(batches)).alias("batch")
    empty = [F.lit(None).cast("binary").alias(n) for n in ("keys", "hot", "starts", "counts", "docs", "ties")]
    known = light.join(firsts, "_sha").select(batch, "doc", "tie", (F.col("doc") == F.col("_first")).alias("first"), *empty)
    texts = keyed("doc_id", "text", batch).groupBy("batch")
    keys = texts.cogroup(known.groupBy("batch")).applyInArrow(count_keys(length, batches), KEYS)
    common = keys.groupBy("bucket").applyInArrow(common_keys(hot), NOTES)
    *steps, last = round_steps(batches, fan)
    runs = texts.cogroup(known.unionByName(common).groupBy("batch")).applyInArrow(send_runs(length, batches, steps[0]), RUNS)
    for step in [*steps[1:], last]:
        runs = runs.groupBy("bucket").applyInArrow(thin_common(length, batches, step), RUNS)
    ranges = runs.groupBy("bucket").applyInArrow(find_repeats(length, batches), NOTES)
    return texts.cogroup(known.unionByName(ranges).groupBy("batch")).applyInArrow(cut_texts(length), CUT)


def dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """``remove_repeats`` with the digest of the kept bytes instead of the bytes."""
    return remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
