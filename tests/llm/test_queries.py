"""The registered queries on the smallest tables: their columns, and their SQL where there is one."""

import os

import pytest
from oracle import compare, connect

import corpus_pipeline
from framelane.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("FRAMELANE_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1": "vec_id n_links component_id kept",
    "op2": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3": "page_id host path rule verdict",
    "op4": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5": "doc_id fingerprint component_id",
    "op6": "doc_id size source_size target taken",
    "op7": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10": "doc_id size text_crc32 law shard slot grown_shard",
    "op11": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op12": "doc_id n_bytes n_tokens over_limit",
    "op13": "anchor_id positive_id rank negative_id positive_score negative_score",
}
TABLES = {"op1": "embeddings", "op3": "pages"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    number = name.split("_")[0]
    df = QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[number].split()) <= set(df.columns)
    if number == "op13":  # a row per negative; its SQL holds the rows
        return
    assert df.count() == spark.read.parquet(f"{SF_DIR}/{TABLES.get(number, 'documents')}.parquet").count()


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    assert compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR).startswith("ok")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    last = corpus_pipeline.run(spark, SF_DIR)
    rows = last.collect()
    assert len(rows) == docs.count() and all(len(r.ids) == r.n_tokens for r in rows)
    assert not docs.where("text RLIKE '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9-]+'").count()
