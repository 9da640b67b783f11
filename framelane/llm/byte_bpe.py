"""Byte-level BPE over Arrow batches.

Texts are cut by the pattern into pieces, each encoded by itself from a rank file. ``tiktoken`` does both in one call for a text, without
a Python object for a piece. It gives up on a text with a million blanks in a row, so long texts are cut here and their pieces encoded by
a ``tokenizers`` BPE model: bytes are written as the usual printable characters, every way to cut a token into two tokens is a merge,
ordered by the token's rank. Decoding looks ids up in the reversed byte table.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, models

from framelane.llm.shared import give_back, remembered


def byte_table() -> tuple[str, ...]:
    """The printable character of each byte: itself where it is one, else the next free character from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return tuple(chr(b if b in plain else next(spare)) for b in range(256))


class ByteBpe:
    """One vocabulary; ``ranks`` maps a token's bytes to its id, the lower the earlier it is merged."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, long_chars: int = 200_000):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.raw = {i: raw for raw, i in ranks.items()}
        self.long_chars = long_chars
        self._encode_text = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes_of = pa.array([self.raw.get(i) for i in range(max(self.raw) + 1)], pa.large_binary())
        self._hidden = str.maketrans({chr(b): c for b, c in enumerate(byte_table())})

    @cached_property
    def tokenizer(self) -> Tokenizer:
        ranks, chars = self.ranks, byte_table()
        name = lambda raw: "".join([chars[b] for b in raw])
        merges = []
        for raw, rank in sorted(ranks.items(), key=lambda x: x[1]):
            cuts = [(raw[:i], raw[i:]) for i in range(1, len(raw)) if raw[:i] in ranks and raw[i:] in ranks]
            merges += [(name(a), name(b)) for a, b in reversed(cuts) if max(ranks[a], ranks[b]) < rank or len(raw) == 2]
        return Tokenizer(models.BPE(vocab={name(raw): i for raw, i in ranks.items()}, merges=merges))

    def encode_pieces(self, text: str) -> list[int]:
        """The ids of a text piece by piece, each distinct piece encoded once."""
        pieces = self.pattern.findall(text)
        fresh = list(set(pieces))
        hidden = [p.encode().decode("latin-1").translate(self._hidden) for p in fresh]
        known = {p: e.ids for p, e in zip(fresh, self.tokenizer.encode_batch_fast(hidden, add_special_tokens=False))}
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        for text in texts:
            yield self._encode_text(text) if len(text) <= self.long_chars else self.encode_pieces(text)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def decoded_sha256(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """Per text the digest of the bytes its ids decode to; text ``i`` has the ids ``flat[ends[i]:ends[i + 1]]``."""
        if not len(flat):
            return [hashlib.sha256().hexdigest()] * (len(ends) - 1)
        _, starts, decoded = self._bytes_of.take(pa.array(flat)).buffers()
        at, raw = np.frombuffer(starts, np.int64)[ends].tolist(), memoryview(decoded)
        return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in pairwise(at)]

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text token by token; a character split over tokens comes with its last one, a broken one as U+FFFD."""
        decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for i in ids:
            yield decoder.decode(self.raw[i])
        yield decoder.decode(b"", True)

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Per token its byte span and its character span; a token inside a character has that character's span."""
        ends = np.cumsum([len(self.raw[i]) for i in self.encode(text)], dtype=np.int64)
        byte_span = np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1).astype(np.int64) if len(ends) else np.zeros((0, 2), np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.concatenate([np.cumsum((raw & 0xC0) != 0x80), [0]])  # 1-based number of the character a byte belongs to
        char_span = np.stack([char_of[byte_span[:, 0]] - 1, char_of[byte_span[:, 1] - 1]], axis=1) if len(ends) else byte_span
        return byte_span, char_span


def load(path: str, pattern: str) -> ByteBpe:
    """A rank file (base64 token and rank per line), read once per Python worker, which has one core."""

    def read() -> ByteBpe:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return ByteBpe(ranks, pattern)

    return remembered((path, pattern), read)


def token_rows(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, and ``ids array<int>``, ``n_tokens``, ``decoded_sha256`` (of the bytes the ids decode to).

    A null text counts as empty and has no ids. Columns of ``docs`` with these names are replaced.
    """

    names = [c for c in docs.columns if c not in (text_col, "ids", "n_tokens", "decoded_sha256")]
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema], "ids array<int>, n_tokens int, decoded_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # so that the ids of few texts exist at once
                part = batch.slice(at, 256)
                ids = list(bpe.encode_all([t or "" for t in part.column(len(names)).to_pylist()]))
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                made = [
                    pa.ListArray.from_arrays(ends, flat),
                    pa.array(np.diff(ends)),
                    pa.array(bpe.decoded_sha256(flat, ends), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*names, "ids", "n_tokens", "decoded_sha256"])
            give_back()

    return docs.select(*names, F.col(text_col).alias("_text")).mapInArrow(run, fields)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``: encodes, then decodes the ids.

    Null and empty texts have no tokens (digests of the empty string); repeated rows are encoded alike; other columns are not read.
    One pass, no shuffle. The vocabulary's path must exist on every worker.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        digits = {i: str(i) for i in bpe.raw}
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for at in range(0, batch.num_rows, 256):
                for ids in bpe.encode_all([t or "" for t in batch.column("text").slice(at, 256).to_pylist()]):
                    counts.append(len(ids))
                    encoded.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return given.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
