"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from framelane.llm import alignment, byte_bpe, feistel, hard_negatives, license_index, lpf_dedup, mixing, pii_anchors, quality_risk, rp_forest, simhash_tiles, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_rp_forest_dedup(spark, sf_dir):
    return rp_forest.dedup(table(spark, sf_dir, "embeddings"))


@query
def op2_pii_anchors(spark, sf_dir):
    return pii_anchors.scan(table(spark, sf_dir, "documents"))


@query
def op3_url_ngrams(spark, sf_dir):
    return url_filter.judge_pages(table(spark, sf_dir, "pages"))


@query
def op4_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op5_simhash_tiles(spark, sf_dir):
    return simhash_tiles.dedup(table(spark, sf_dir, "documents"))


@query
def op6_mixing_tree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    draws = F.array_join(F.col("shard_draws").cast("array<string>"), ",").alias("shard_draws")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.size("shards").cast("long").alias("n_copies"), draws)


ORACLES["op6_mixing_tree"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), b AS (
  SELECT *, ('0x' || substr(md5(concat_ws(':', doc_id, size)), 1, 3))::BIGINT % 1024 AS block FROM d
), blocks AS (
  SELECT source, block, sum(size)::BIGINT AS words FROM b GROUP BY ALL
), sources AS (
  SELECT source, sum(words)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM blocks GROUP BY source
), weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rank - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM sources
), levels AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighted
), flagged AS (
  SELECT *, (total - caps) / rest * w >= cap AS is_full FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
    (total - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)) / (sum(w) FILTER (WHERE NOT is_full) OVER ()) * w END AS target
  FROM flagged
), passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
), cut AS (
  SELECT bl.source, bl.block, p.source_size, p.target, p.whole, bl.words > 0 AND
    coalesce(sum(bl.words) OVER (PARTITION BY bl.source ORDER BY md5('7:' || bl.block), bl.block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
      + bl.words::DOUBLE / 2 <= p.target - p.whole * p.source_size AS part
  FROM blocks bl JOIN passes p ON bl.source IS NOT DISTINCT FROM p.source
)
, nodes AS (
  SELECT 0 AS low, 16 AS high, sum(whole + part::BIGINT)::BIGINT AS draws FROM cut
  UNION ALL
  SELECT CASE WHEN side = 0 THEN low ELSE (low + high) // 2 END, CASE WHEN side = 0 THEN (low + high) // 2 ELSE high END,
    CASE WHEN side = 0 THEN draws // 2 ELSE draws - draws // 2 END
  FROM nodes, (VALUES (0), (1)) AS s(side) WHERE high - low > 1
)
SELECT b.doc_id, b.size, c.source_size, c.target, (b.size * (c.whole + c.part::BIGINT))::BIGINT AS taken,
  (c.whole + c.part::BIGINT)::BIGINT AS n_copies,
  (SELECT string_agg(draws::VARCHAR, ',' ORDER BY low) FROM nodes WHERE high - low = 1) AS shard_draws
FROM b JOIN cut c ON b.source IS NOT DISTINCT FROM c.source AND b.block = c.block
"""


@query
def op9_license_positions(spark, sf_dir):
    return license_index.scan(table(spark, sf_dir, "documents"))


@query
def op10_feistel_shards(spark, sf_dir):
    return feistel.shard_documents(table(spark, sf_dir, "documents"))


@query
def op7_lpf_dedup(spark, sf_dir):
    return lpf_dedup.dedup(table(spark, sf_dir, "documents"))


@query
def op8_quality_thresholds(spark, sf_dir):
    return quality_risk.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_lockstep_alignment(spark, sf_dir):
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_documents(table(spark, sf_dir, "documents"), a, public_tokenizers.PATTERN, b)


@query
def op12_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLES["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.vec, b.vec)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec)
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 10
"""
