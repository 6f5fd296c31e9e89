"""One query for each operator, over whole tables with production parameters."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe_pieces, jaccard_join, mixing, neighbours, pii, pitman_yor, quality, sharding, token_store, toxicity
from ._common import crc_mod, documents

#: Vocabulary files are parameters of the operators; the queries take the installed public ones.
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def op1_mix_sources(spark, sf_dir):
    out = mixing.mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_nearest_neighbours(spark, sf_dir):
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_quality_rules(spark, sf_dir):
    return quality.metrics(documents(spark, sf_dir))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    entries, coefficients = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, entries, coefficients)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), F.concat_ws(",", "hits").alias("matched"))


def op6_byte_bpe(spark, sf_dir):
    return bpe_pieces.digests(documents(spark, sf_dir), MULTI_RANKS, PATTERN)


def op7_token_store(spark, sf_dir):
    return token_store.build(documents(spark, sf_dir), BYTE_BPE)


def op8_personal_data(spark, sf_dir):
    return pii.detect(documents(spark, sf_dir)).drop("span_list")


def op9_pitman_yor(spark, sf_dir):
    return pitman_yor.score(documents(spark, sf_dir))


def op10_shards(spark, sf_dir):
    out = sharding.shard_by_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_nearest_neighbours, op3_quality_rules, op4_jaccard_join, op5_toxicity, op6_byte_bpe, op7_token_store, op8_personal_data, op9_pitman_yor, op10_shards)}

ORACLE_SQL = {
    "op4_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (SELECT a AS node, b AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen
), c AS (SELECT node, min(seen) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
}
