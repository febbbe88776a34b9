"""The registered queries of this package, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from roleledger.llm import byte_bpe, jaccard_join, line_templates, nn_descent, packing, passages, quality
from roleledger.llm import sharding, toxicity, turns, url_filter, version_sketch, whitening
from roleledger.llm.tables import documents

RANKS = "byte_bpe_50k.tiktoken"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(documents(spark, sf_dir))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op4_version_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_sketch.fingerprints(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nn_descent.nearest(vectors, F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = line_templates.drop_recurring_lines(docs)
    return kept.select("doc_id", F.col("_dropped").cast("long").alias("n_dropped"), "text")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(documents(spark, sf_dir).select("doc_id", "text"))
    crc = F.coalesce(F.crc32("text"), F.lit(0).cast("long")).alias("text_crc32")
    return placed.select("doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return turns.repair(rows, F.col("there"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_passages": op2_passages,
    "op3_url_filter": op3_url_filter,
    "op4_version_sketch": op4_version_sketch,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_nn_descent": op7_nn_descent,
    "op8_packing": op8_packing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_line_templates": op10_line_templates,
    "op11_sharding": op11_sharding,
    "op12_turns": op12_turns,
    "op13_whitening": op13_whitening,
}

# Words as the operators cut them; the distinct 5-word shingles of a text, or the whole sequence.
ORACLES = {
    "op1_jaccard_join": r"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM sets JOIN reach USING (doc_id) GROUP BY sets.doc_id, len(s)""",
    "op3_url_filter": r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
fit AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, v DESC) AS k
    FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE k = 1""",
}
