"""Token counts without token ids.

Every text is cut into pre-tokens (``pretokens``), of which a document holds few distinct ones. The distinct pre-tokens of the whole corpus
are counted once each: dictionaries of blocks of documents meet under the pre-token, equal ones lie next to each other after a sort inside
the partition, and the count goes back to the blocks. A document's count is the sum of its frequencies times those counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framelane.llm import blocks
from framelane.llm.pretokens import cutter
from framelane.llm.shared import give_back

FREQUENCIES = pa.schema([
    ("block", pa.int64()), ("slot", pa.int64()), ("key", pa.string()),
    ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("body", pa.binary()),
])


def frequency_blocks(docs: DataFrame, path: str, id_col: str, text_col: str, block_keys: int = 600_000, part_rows: int = 512) -> DataFrame:
    """The block table of pre-tokens: a block ends with its task, or when it has ``block_keys`` keys or 16 characters for each of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, block, chars = cutter(path).pretokens, blocks.Block(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, part_rows):
                part = batch.slice(at, part_rows)
                found = [Counter(cut(t)) for t in part.column("text").to_pylist()]
                known = len(block.slots)
                body = blocks.document_body(
                    np.fromiter(map(len, found), np.int64), block.find(chain.from_iterable(found)), np.fromiter(chain.from_iterable(f.values() for f in found), np.int64)
                )
                yield blocks.document_row(block, FREQUENCIES, {"doc_ids": part.column("doc_id").to_pylist(), "sizes": part.column("n_bytes").to_pylist(), "body": body})
                if len(block.slots) > known:
                    chars += sum(map(len, list(block.slots)[known:]))
                if len(block.slots) >= block_keys or chars >= 16 * block_keys:
                    yield from blocks.key_rows(block, FREQUENCIES)
                    block, chars = blocks.Block(), 0
            give_back()
        yield from blocks.key_rows(block, FREQUENCIES)

    return given.mapInArrow(run, "block long, slot long, key string, doc_ids array<long>, sizes array<long>, body binary")


def count_pretokens(keys: DataFrame, path: str, at_once: int = 1_000_000) -> DataFrame:
    """``block, body``: slots and token counts. ``keys`` has ``block, slot, key``; equal keys meet and are counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, last, last_n = cutter(path), None, 0
        held: dict[int, list] = defaultdict(list)
        size = 0

        def give() -> pa.RecordBatch:
            bodies = [blocks.pack(*map(np.concatenate, zip(*parts))) for parts in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(bodies, pa.binary())], ["block", "body"])

        for batch in batches:
            runs = pa.compute.run_end_encode(batch.column("key"), run_end_type=pa.int64())
            values, ends = runs.values.to_pylist(), np.asarray(runs.run_ends)
            fresh = values[1:] if values and values[0] == last else values
            counts = np.array([last_n] * (len(values) - len(fresh)) + [len(ids) for ids in model.ids_of(fresh)], np.int64)
            if values:
                last, last_n = values[-1], counts[-1]
            each = np.repeat(counts, np.diff(ends, prepend=0))
            number, slot = batch.column("block").to_numpy(), batch.column("slot").to_numpy()
            order = np.lexsort((slot, number))
            starts = np.flatnonzero(np.diff(number[order], prepend=-1))
            for own in np.split(order, starts[1:]) if len(order) else []:
                held[int(number[own[0]])].append((slot[own], each[own]))
            size += len(order)
            if size >= at_once:
                yield give()
                held.clear()
                size = 0
        yield give()

    met = keys.repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(run, "block long, body binary")


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _sum_up(documents: pa.Table, values: pa.Table) -> pa.Table:
    slots = [blocks.unpack(b) for b in values.column("body").to_pylist()]
    count = np.zeros(sum(len(s) for s, _ in slots), np.int64)
    for slot, n in slots:
        count[slot] = n
    parts = []
    for ids, sizes, body in zip(*(documents.column(c).to_pylist() for c in ("doc_ids", "sizes", "body"))):
        owner, slot, times = blocks.read_body(body)
        n_tokens = blocks.sums(owner, count[slot] * times, len(ids))
        parts.append(pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(n_tokens)], schema=COUNTS))
    return pa.concat_tables(parts) if parts else COUNTS.empty_table()


def count_tokens(
    docs: DataFrame, path: str, limit: int = 4096, block_keys: int = 600_000, part_rows: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens) for every row of ``docs``.

    ``path`` names a sentencepiece BPE model with byte fallback that must exist on every worker. Null and empty texts have no bytes and no
    tokens; null ids stay null; repeated rows are counted alike, each as a row of its own; texts of any length are counted whole, a text's
    frequencies being the most a task holds at once beside a block's keys; an empty table gives an empty table; other columns are not read,
    so their names cannot clash. A common pre-token comes once per block of documents, however often it occurs.
    """
    table = blocks.written(frequency_blocks(docs, path, id_col, text_col, block_keys, part_rows), "frequencies")
    documents = table.where("body IS NOT NULL").select("block", "doc_ids", "sizes", "body")
    values = count_pretokens(table.where("key IS NOT NULL").select("block", "slot", "key"), path)
    summed = documents.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_sum_up, "doc_id long, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
