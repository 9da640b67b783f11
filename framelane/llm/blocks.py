"""Documents in blocks, each with a dictionary of the keys that its documents hold.

Joining a corpus-wide value to every (document, key) pair would shuffle about as many rows as the corpus has words. Here a task gives its
documents to a block, writes each distinct key of the block once, and the documents as numbers of keys with their frequencies. Only the
dictionaries meet the corpus-wide values; what comes back is one value per key and block.

A table of blocks has two sorts of rows: keys (``block, slot, key, n_docs``) and documents (``block``, arrays with one item per document,
``body``). It is written to the shared folder before it is used, so the random block numbers are fixed and a lost executor costs no more
than the step that reads it.
"""

from __future__ import annotations

import os
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from framelane.llm.shared import shared_folder


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, each in the narrowest width that holds it, lowest bytes first, compressed."""
    parts = []
    for values in arrays:
        most = int(values.max()) if len(values) else 0
        width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
        parts += [np.array([len(values), width], np.int64).tobytes(), values.astype(f"<u{width}").view("u1").reshape(-1, width).T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(body: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    while at < len(raw):
        n, width = np.frombuffer(raw, np.int64, 2, at).tolist()
        planes = np.frombuffer(raw, "u1", n * width, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
        at += 16 + n * width
    return out


class Block:
    """The dictionary of one block; a key's slot is its place in the order of arrival, so common keys have small slots."""

    def __init__(self):
        self.number = int.from_bytes(os.urandom(8), "little") >> 1
        self.slots: defaultdict = defaultdict()
        self.slots.default_factory = self.slots.__len__

    def find(self, keys) -> np.ndarray:
        return np.fromiter(map(self.slots.__getitem__, keys), np.int64)


def document_body(lengths: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> bytes:
    """Documents that hold ``lengths`` keys each: their slots (distinct in a document) and how often each occurs."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((slots, owner))
    slots = slots[order]
    steps = np.diff(slots, prepend=0)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    steps[starts] = slots[starts]
    return pack(lengths, steps, counts[order])


def read_body(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document of each (document, key) pair, slots, counts: as given to ``document_body``, in order of document and slot."""
    lengths, steps, counts = unpack(body)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    total = np.cumsum(steps)
    starts = np.cumsum(lengths) - lengths
    before = np.concatenate([[0], total])[np.minimum(starts, len(total))]
    return owner, total - np.repeat(before, lengths), counts


def key_rows(block: Block, schema: pa.Schema, n_docs: np.ndarray | None = None, at_once: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The dictionary of a block; columns of documents are null."""
    keys = list(block.slots)
    for at in range(0, len(keys), at_once):
        own = keys[at : at + at_once]
        known = {"block": [block.number] * len(own), "slot": np.arange(at, at + len(own)), "key": own}
        if n_docs is not None:
            known["n_docs"] = n_docs[at : at + len(own)]
        yield pa.RecordBatch.from_arrays([pa.array(known[f.name], f.type) if f.name in known else pa.nulls(len(own), f.type) for f in schema], schema=schema)


def document_row(block: Block, schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """One row of documents; columns of keys are null."""
    known = {"block": block.number, **columns}
    return pa.RecordBatch.from_arrays([pa.array([known.get(f.name)], f.type) for f in schema], schema=schema)


def written(table: DataFrame, name: str) -> DataFrame:
    """The rows of ``table`` from a Parquet table in the shared folder."""
    path = f"{shared_folder(table.sparkSession)}/{name}-{uuid.uuid4().hex}"
    table.write.option("compression", "zstd").parquet(path)
    return table.sparkSession.read.parquet(path)


def sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums per document."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.searchsorted(owner, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]
