"""Aligning the tokens of two tokenizers over the same bytes.

Both tokenizers cut the bytes of space + text. A-B tokens whose bytes overlap are linked; where both cut, a group ends. All documents of a
batch are merged in lockstep: one NumPy state vector holds an A and a B pointer per lane; each step emits the link under every lane's
pointers and a cut where both tokens end, moves on the pointers of the tokens that end first, and drops finished lanes. A long document is
several lanes, each starting at an A token with the B token that covers its first byte, so one long text does not make a batch run on with
a single lane.

How common a linked pair of ids is in the corpus comes from the dictionaries of the blocks of documents (``blocks``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from framelane.llm import blocks
from framelane.llm.byte_bpe import byte_table
from framelane.llm.pretokens import cutter
from framelane.llm.shared import give_back, remembered


class ByteVocabulary:
    """Tokenizer A: a byte-level BPE file of the tokenizers library, encoded by its ranks; special tokens stay out."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        special = {t["content"] for t in given["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_table())}
        ranks = {bytes(map(back.__getitem__, token)): i for token, i in given["model"]["vocab"].items() if token not in special}
        self.encode = tiktoken.Encoding("A", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.raw = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.raw[i] = token


class Pair:
    """Both tokenizers with the tables that the alignment needs."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        self.a, self.b = ByteVocabulary(path_a, pattern), cutter(path_b)
        self.length_a, self.length_b = (np.array([len(t) for t in raw], np.int64) for raw in (self.a.raw, self.b.raw))
        self.n_a = len(self.a.raw)
        # what follows an id in the written groups: "," inside a side, "|" after the A side, ";" after the group
        self.written = [f"{i}{end}".encode() for ends, raw in ((",|", self.a.raw), (",;", self.b.raw)) for i in range(len(raw)) for end in ends]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of space + text by A and of text by B; none where the text is empty or either side's bytes are other bytes."""
        ids_a, ids_b = [self.a.encode(" " + t) if t else [] for t in texts], self.b.encode_all(texts)
        for k, text in enumerate(texts):
            whole = b" " + text.encode()
            if text and not all(b"".join(map(raw.__getitem__, ids)) == whole for raw, ids in ((self.a.raw, ids_a[k]), (self.b.raw, ids_b[k]))):
                ids_a[k], ids_b[k] = [], []
        return ids_a, ids_b


def merge(end_a: np.ndarray, end_b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token) and whether a cut follows each, of tokens that end at ``end_a`` and ``end_b``; the last ends are equal.

    ``starts`` has the first A token of every lane, in order, 0 first. A lane ends where the next one starts.
    """
    begin = np.concatenate([[0], end_a[:-1]])[starts]
    i, j, stop = starts, np.searchsorted(end_b, begin, side="right"), np.append(starts[1:], len(end_a))
    links: list[tuple] = []
    while len(i):
        a, b = end_a[i], end_b[j]
        links.append((i, j, a == b))
        i, j = i + (a <= b), j + (b <= a)
        alive = i < stop
        if not alive.all():
            i, j, stop = i[alive], j[alive], stop[alive]
    return tuple(map(np.concatenate, zip(*links))) if links else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def align(pair: Pair, texts: list[str], lane: int = 256) -> dict:
    """The tokens of some texts side by side: per document counts and the digest of its groups, and ``links`` (document, A id, B id)."""
    ids_a, ids_b = pair.encode(texts)
    n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(texts)) for ids in (ids_a, ids_b))
    flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
    owner_a = np.repeat(np.arange(len(texts)), n_a)
    first = np.cumsum(n_a) - n_a
    starts = np.flatnonzero((np.arange(len(flat_a)) - first[owner_a]) % lane == 0)
    at_a, at_b, cut = merge(np.cumsum(pair.length_a[flat_a]), np.cumsum(pair.length_b[flat_b]), starts)
    cut_a, cut_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
    cut_a[at_a[cut]], cut_b[at_b[cut]] = True, True
    last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    # in the written groups an A token follows the B tokens of earlier groups, a B token the A tokens of its own group too
    order = np.zeros(len(flat_a) + len(flat_b), np.int64)
    order[np.arange(len(flat_a)) + np.concatenate([[0], last_b + 1])[np.cumsum(cut_a) - cut_a]] = 2 * flat_a + cut_a
    if len(flat_b):
        order[np.arange(len(flat_b)) + last_a[np.cumsum(cut_b) - cut_b] + 1] = 2 * (pair.n_a + flat_b) + cut_b
    ends = np.cumsum(n_a + n_b)
    digests = []
    for low, high in zip((ends - n_a - n_b).tolist(), ends.tolist()):
        written = b"".join(map(pair.written.__getitem__, order[low:high].tolist()))[:-1]
        digests.append(hashlib.sha256(written).hexdigest() if high > low else "")
    count = lambda owners: np.bincount(owners, minlength=len(texts))
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": count(owner_a[last_a]), "n_links": count(owner_a[at_a]), "groups_sha256": digests,
        "links": (owner_a[at_a], flat_a[at_a], flat_b[at_b]),
    }


COUNTED = ("n_a", "n_b", "n_groups", "n_links")
LINKED = pa.schema([
    ("block", pa.int64()), ("slot", pa.int64()), ("key", pa.int64()), ("n_docs", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    *[(c, pa.list_(pa.int64())) for c in COUNTED], ("groups_sha256", pa.list_(pa.string())), ("body", pa.binary()),
])


def link_blocks(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str, text_col: str, block_keys: int = 600_000, part_chars: int = 3_000_000) -> DataFrame:
    """The block table of linked pairs; some ``part_chars`` characters are merged in lockstep at once. A key is A id x 2^32 + B id."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = remembered((path_a, pattern, path_b), lambda: Pair(path_a, pattern, path_b))
        block, n_docs = blocks.Block(), np.zeros(0, np.int64)
        for ids, texts in parts(batches, part_chars):
            found = align(pair, texts)
            owner, a, b = found.pop("links")
            keys, place = np.unique(a << 32 | b, return_inverse=True)
            pairs, times = np.unique(owner * len(keys) + place, return_counts=True)
            slots = block.find(keys.tolist())[pairs % len(keys)] if len(keys) else pairs
            n_docs = np.concatenate([n_docs, np.zeros(len(block.slots) - len(n_docs), np.int64)])
            n_docs += np.bincount(slots, minlength=len(n_docs))
            lengths = np.bincount(pairs // max(len(keys), 1), minlength=len(texts)) if len(pairs) else np.zeros(len(texts), np.int64)
            columns = {k: v if isinstance(v, list) else v.tolist() for k, v in found.items()}
            yield blocks.document_row(block, LINKED, {"doc_ids": ids, **columns, "body": blocks.document_body(lengths, slots, times)})
            if len(block.slots) >= block_keys:
                yield from blocks.key_rows(block, LINKED, n_docs)
                block, n_docs = blocks.Block(), np.zeros(0, np.int64)
            give_back()
        yield from blocks.key_rows(block, LINKED, n_docs)

    lists = ", ".join(f"{c} array<long>" for c in ("doc_ids", *COUNTED))
    return given.mapInArrow(run, f"block long, slot long, key long, n_docs long, {lists}, groups_sha256 array<string>, body binary")


def parts(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of some documents at a time, ``chars`` characters or the document that goes beyond them."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            own = batch.slice(at, 64)
            for i, text in zip(own.column("doc_id").to_pylist(), own.column("text").to_pylist()):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size >= chars:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in (*COUNTED, "n_best", "count_sum")], ("groups_sha256", pa.string())])


def _look_up(documents: pa.Table, values: pa.Table) -> pa.Table:
    slot = values.column("slot").to_numpy()
    count, best = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
    count[slot], best[slot] = values.column("n_docs").to_numpy(), values.column("best").to_numpy()
    tables = []
    for row in documents.to_pylist():
        owner, slots, times = blocks.read_body(row["body"])
        n = len(row["doc_ids"])
        summed = {"n_best": blocks.sums(owner, best[slots] * times, n), "count_sum": blocks.sums(owner, count[slots] * times, n)}
        columns = {"doc_id": row["doc_ids"], **summed, **{c: row[c] for c in (*COUNTED, "groups_sha256")}}
        tables.append(pa.table([pa.array(columns[f.name], f.type) for f in RESULT], schema=RESULT))
    return pa.concat_tables(tables) if tables else RESULT.empty_table()


def pair_counts(keys: DataFrame) -> DataFrame:
    """``key, n_docs, best`` of the whole corpus: documents that hold a pair, and 1 where no pair of its A id is in more, else 0."""
    counts = keys.groupBy("key").agg(F.sum("n_docs").alias("n_docs")).withColumn("a", F.shiftright("key", 32))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("key", "n_docs", (F.col("n_docs") == F.col("most")).cast("long").alias("best"))


def align_documents(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    ``path_a`` is a byte-level BPE of the tokenizers library, ``pattern`` its split, ``path_b`` a sentencepiece BPE with byte fallback; both
    files must exist on every worker. Null and empty texts, and those that a tokenizer changes, have no tokens: zeros and an empty digest.
    Null ids stay null; a repeated row is a row and a document of its own; texts of any length are aligned whole; an empty table gives an
    empty table; other columns are not read, so their names cannot clash. A pair that stands in every document comes once per block.
    """
    table = blocks.written(link_blocks(docs, path_a, pattern, path_b, id_col, text_col), "links")
    documents = table.where("body IS NOT NULL").select("block", "doc_ids", *COUNTED, "groups_sha256", "body")
    keys = table.where("key IS NOT NULL").select("block", "slot", "key", "n_docs")
    values = keys.drop("n_docs").join(pair_counts(keys), "key").select(F.col("block").alias("block"), "slot", "n_docs", "best")
    schema = ", ".join(["doc_id long", *[f"{c} long" for c in (*COUNTED, "n_best", "count_sum")], "groups_sha256 string"])
    return documents.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_look_up, schema)
