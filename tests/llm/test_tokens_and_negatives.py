"""Token counts, cross-tokenizer alignment and hard negatives against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from llm_texts import prose
from tokenizers import Tokenizer

from framelane.llm import alignment, blocks, hard_negatives, pretokens, token_counts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["a", "the", " ", "  ", "▁", "\n", "\t", "5", "12", ".", "é", "中文", "ﬁ", "\x00", "<s>", "<0x41>", "<|endoftext|>", "'s", "🙂", "Straße", " ", "stone"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=20).map("".join)


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=B)


@settings(max_examples=600, deadline=None)
@given(st.lists(TEXTS, max_size=4), st.sampled_from([0, 20, 10**6]))
def test_pretokens_give_the_ids_of_whole_texts(model, texts, memory):
    assert pretokens.cutter(B).encode_all(texts, memory) == model.encode(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 10**6), st.integers(1, 70_000), max_size=5), max_size=6))
def test_document_bodies(found):
    lengths, slots, counts = (np.array(x, np.int64) for x in ([len(f) for f in found], [k for f in found for k in f], [v for f in found for v in f.values()]))
    owner, slot, times = blocks.read_body(blocks.document_body(lengths, slots, counts))
    assert list(zip(owner.tolist(), slot.tolist(), times.tolist())) == [(i, k, f[k]) for i, f in enumerate(found) for k in sorted(f)]
    assert blocks.sums(owner, slot * times, len(found)).tolist() == [sum(k * v for k, v in f.items()) for f in found]


def test_counts(spark, model, rng):
    texts = [None, "", " ", "  a", "▁", *["the " * 5000] * 3, prose(rng, 20_000), "x" * 50_000, "\n" * 300] + ["".join(rng.choices(PIECES, k=rng.randrange(60))) for _ in range(400)]
    rows = [(i if i % 50 else None, t, "n", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[5:9], "doc_id long, text string, block string, n_tokens int").repartition(3)
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for i, t, _, _ in rows + rows[5:9])
    assert Counter(map(tuple, token_counts.count_tokens(df, B, limit=100).collect())) == want
    table = blocks.written(token_counts.frequency_blocks(df, B, "doc_id", "text", block_keys=40, part_rows=8), "test")  # several blocks in a task
    assert table.select("block").distinct().count() > 10
    assert Counter(map(tuple, token_counts.count_tokens(df, B, 100, block_keys=40, part_rows=8).collect())) == want
    assert token_counts.count_tokens(df.limit(0), B).collect() == []


def test_counted_once_and_returned_in_slices(spark, model):
    keys = [(b, s, k) for b in (1, 2, 3) for s, k in enumerate([" the", "\n", " stone", " Straße", "5"])]
    df = spark.createDataFrame(keys, "block long, slot long, key string")
    slices = token_counts.count_pretokens(df, B, at_once=1).collect()
    got = sorted((r.block, int(s), int(n)) for r in slices for s, n in zip(*blocks.unpack(r.body)))
    assert got == sorted((b, s, len(model.encode(k[1:] if k[0] == " " else k)) - (k[0] != " ")) for b, s, k in keys)


def reference_alignment(rows, model):
    """Per row, by loops over byte sets."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    back = {c: b for b, c in enumerate(alignment.byte_table())}
    raw_a = lambda i: bytes(back[c] for c in tokenizer.id_to_token(i))
    raw_b = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    docs, holders = [], Counter()
    for _, text in rows:
        a, b = (tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        if text and not b"".join(map(raw_a, a)) == b"".join(map(raw_b, b)) == (" " + text).encode():
            a, b = [], []
        ends = [np.cumsum([0] + [len(raw(i)) for i in ids]).tolist() for ids, raw in ((a, raw_a), (b, raw_b))]
        links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if ends[0][i] < ends[1][j + 1] and ends[1][j] < ends[0][i + 1]]
        cuts = sorted(set(ends[0][1:]) & set(ends[1][1:]))
        groups, low = [], 0
        for high in cuts:
            sides = [",".join(str(t) for t, e in zip(ids, end[1:]) if low < e <= high) for ids, end in zip((a, b), ends)]
            groups.append("|".join(sides))
            low = high
        docs.append((a, b, groups, links))
        holders.update(set(links))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    return Counter(
        (i, len(a), len(b), len(groups), len(links), sum(holders[l] == most[l[0]] for l in links), sum(holders[l] for l in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for (i, _), (a, b, groups, links) in zip(rows, docs)
    )


def test_alignment(spark, model, rng):
    texts = [None, "", " ", "a▁b", "<|endoftext|> <s>", "x" * 700, prose(rng, 300), *["the stone"] * 4] + ["".join(rng.choices(PIECES, k=rng.randrange(40))) for _ in range(150)]
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_a int").repartition(3)
    got = alignment.align_documents(df, A, public_tokenizers.PATTERN, B)
    assert Counter(map(tuple, got.collect())) == reference_alignment(rows, model)
    assert alignment.align_documents(df.limit(0), A, public_tokenizers.PATTERN, B).collect() == []
    one = {tuple(r) for r in df.where("text IS NOT NULL").selectExpr("doc_id", "text").collect()}
    tables = [alignment.link_blocks(df, A, public_tokenizers.PATTERN, B, "doc_id", "text", n, c) for n, c in ((1, 100), (10**6, 10**6))]
    few, many = (sum(len(r.doc_ids) for r in t.where("body IS NOT NULL").collect()) for t in tables)
    assert few == many == len(rows) and one  # small blocks and parts lose no document


@pytest.mark.parametrize("lane", [1, 3, 256])
def test_lanes_do_not_change_links(lane):
    rng = np.random.default_rng(lane)
    for _ in range(50):
        total = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, 20)), total)) for _ in range(2)]
        starts = np.arange(0, len(ends[0]), lane)
        i, j, cut = alignment.merge(*ends, starts)
        begins = [np.concatenate([[0], e[:-1]]) for e in ends]
        want = {(x, y) for x in range(len(ends[0])) for y in range(len(ends[1])) if begins[0][x] < ends[1][y] and begins[1][y] < ends[0][x]}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want
        assert sorted(ends[0][i[cut]].tolist()) == sorted(set(ends[0].tolist()) & set(ends[1].tolist()))


def test_long_text_of_one_byte_tokens_is_many_lanes():
    """A 1 MB text has steps as short as its lanes, not as long as itself."""
    pair = alignment.Pair(A, public_tokenizers.PATTERN, B)
    found = alignment.align(pair, ["7 " * 200_000, "", "a b"])
    assert found["n_a"][0] == 200_001 and found["n_a"][1:].tolist() == [0, 2] and found["n_groups"][2] == 2
    assert found["groups_sha256"][1] == "" and len(found["links"][0]) == found["n_links"].sum()


def reference_negatives(rows, positives=5, negatives=10):
    held = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = int(np.fmod(label + 1, 10)) if i % 7 == 0 else label
        own = (label, [max(-(2**24), min(2**24, int(np.floor(x * 256)))) for x in v])
        held[i] = min(held.get(i, own), own)
    out = []
    for a, (label, v) in held.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own == label) for i, (own, w) in held.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(n, i) for n, i, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s][:negatives]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(fit, 1)]
    return out


def vector_rows(seed, n=700):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(6).round(seed % 3)], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(10_000 + i, rows[100][1], 1) for i in range(0, 300)]  # a large group of equal vectors
    rows += [(200, rows[0][1], 2), (300, rows[300][1], 2), (300, rows[300][1], 2), (None, rows[1][1], 1), (20_000, None, 1), (20_100, [1.0, None], 1)]
    rows += [(20_200, [float("nan")] * 6, 1), (20_300, [float("inf")] * 6, 1), (20_400, [], 1), (20_500, [], 1), (20_501, [], 2), (20_600, [1.0, 2.0], 1), (20_601, [1.0, 2.0], 1), (20_602, [0.5, 1.0], 3)]
    rows += [(20_700, [0.0] * 6, 0), (20_701, [0.0] * 6, 0), (20_800, [1e300] * 6, 0), (20_801, [1e200] * 6, 0), (20_802, [40_000.0] * 6, 1), (-100, rows[3][1], 3), (21_000, rows[4][1], None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed):
    rows = vector_rows(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, score int")
    want = Counter(reference_negatives(rows))
    assert len(want) > 100
    for tiles in ({}, {"rows_per_tile": 60, "anchors_per_tile": 3}):
        assert Counter(map(tuple, hard_negatives.hard_negatives(df, **tiles).collect())) == want
    assert hard_negatives.hard_negatives(df.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-(2**62), 2**62)] * 2, st.booleans(), st.integers(-(2**63), 2**63 - 1)), max_size=8))
def test_packed_keys(records):
    assert [hard_negatives.unpack_key(hard_negatives.pack_key(*r)) for r in records] == records
    assert sorted(hard_negatives.pack_key(*r) for r in records) == [hard_negatives.pack_key(*r) for r in sorted(records, key=lambda r: (r[0], -r[1], r[2], r[3]))]
