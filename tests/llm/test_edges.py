"""Every operator on odd rows and on an empty table: nothing breaks, and each row has its defined result."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framelane.llm import byte_bpe, feistel, license_index, lpf_dedup, mixing, pii_anchors, quality_risk, rp_forest, simhash_groups, simhash_tiles, url_filter

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda d, l: pii_anchors.scan(d),
    "bpe": lambda d, l: byte_bpe.round_trip(d, RANKS, public_tokenizers.PATTERN),
    "tokens": lambda d, l: byte_bpe.token_rows(d, RANKS, public_tokenizers.PATTERN),
    "simhash": lambda d, l: simhash_tiles.dedup(d),
    "mix": lambda d, l: mixing.mix(d),
    "lpf": lambda d, l: lpf_dedup.dedup(d),
    "quality": lambda d, l: quality_risk.judge_documents(d, l),
    "licence": lambda d, l: license_index.scan(d),
    "shards": lambda d, l: feistel.shard_documents(d),
    "masked": lambda d, l: pii_anchors.mask_rows(d),
}
KEPT = {
    "keep_good": lambda d, l: quality_risk.keep_good(d, l),
    "keep_one": lambda d, l: simhash_groups.keep_one(d),
    "mixed": lambda d, l: mixing.mixed_rows(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd_documents, no_documents, labels):
    rows = OPERATORS[name](odd_documents, labels).collect()
    assert len(rows) == odd_documents.count()
    assert OPERATORS[name](no_documents, labels).collect() == []
    assert len(OPERATORS[name](odd_documents, labels.limit(0)).collect()) == len(rows)


@pytest.mark.parametrize("name", KEPT)
def test_kept_rows_have_their_columns(name, odd_documents, no_documents, labels):
    kept = KEPT[name](odd_documents, labels)
    assert kept.columns == odd_documents.columns and kept.count() > 0
    assert KEPT[name](no_documents, labels).count() == 0


def test_results_of_null_and_empty_texts(odd_documents, labels):
    by_id = lambda rows: {r.doc_id: r for r in rows}
    pii = by_id(OPERATORS["pii"](odd_documents, labels).collect())
    assert pii[2].base_sha256 == pii[3].base_sha256 == EMPTY and pii[2].spans == ""
    bpe = by_id(OPERATORS["bpe"](odd_documents, labels).collect())
    assert (bpe[2].n_tokens, bpe[2].ids_sha256, bpe[3].decoded_sha256) == (0, EMPTY, EMPTY)
    sim = by_id(OPERATORS["simhash"](odd_documents, labels).collect())
    assert sim[2].fingerprint == "0" * 16 and {sim[i].component_id for i in (2, 3, 4)} == {2}
    lpf = by_id(OPERATORS["lpf"](odd_documents, labels).collect())
    assert (lpf[2].n_bytes, lpf[2].n_removed, lpf[2].kept_sha256) == (0, 0, EMPTY)
    assert lpf[6].n_removed == 998 and lpf[6].n_spans == 1  # of 1000 bytes of one letter of two bytes, the first two stay
    assert lpf[10].n_removed == lpf[10].n_bytes and lpf[1].n_removed == 0
    quality = by_id(OPERATORS["quality"](odd_documents, labels).collect())
    assert quality[2].base_failed and quality[4].n_words == 0 and not quality[2].kept and quality[5].kept
    licence = by_id(OPERATORS["licence"](odd_documents, labels).collect())
    assert (licence[2].n_words, licence[2].first_word, licence[2].labels, licence[2].score) == (0, None, "", 0.0)
    assert by_id(OPERATORS["shards"](odd_documents, labels).collect())[2].size == 16


def test_odd_vectors(spark):
    v = [1.0, 0.0, 0.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, [0.99, 0.05, 0.0], 1), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 0.0], 1),
        (8, [float("nan"), 0.0, 0.0], 1), (9, [float("inf"), 0.0, 0.0], 1), (10, v, 2), (11, [1.0, 0.0], 1), (12, [], 1), (None, v, 1), (2, v, 1),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, component string")
    got = {r.vec_id: r for r in rp_forest.dedup(df).collect()}
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in (1, 2, 3)} == {1: (4, 1, True), 2: (4, 1, False), 3: (4, 1, False)}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert got[None].component_id == 1 and not got[None].kept
    assert rp_forest.dedup(df.limit(0)).collect() == []


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.B.ORG", "http://x.org/p?q#f", "HTTPS://Ü.Example.ORG/es/1", "a://b://c/d", "http://h/" + "p" * 50_000]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[4], "x")], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge_pages(df).collect()}
    assert all((got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow") for i in range(4))
    assert (got[4].host, got[4].path, got[4].rule) == ("a.b.org", "", None)  # an empty path does not start with a slash
    assert (got[5].path, got[5].rule, got[5].verdict) == ("/p", "org/", "allow")
    assert (got[6].host, got[6].rule, got[6].verdict) == ("Ü.example.org", "example.org/es/", "block")
    assert got[7].host == "b:" and len(got[8].path) == 50_001
    assert url_filter.judge_pages(df.limit(0)).collect() == []


def test_native_operators_run_no_python(spark, odd_documents, labels):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    for df in (url_filter.judge_pages(pages), quality_risk.judge_documents(odd_documents, labels), license_index.scan(odd_documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert F is not None
