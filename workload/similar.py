"""Words, weights and similar descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roleledger.functions.text import STOP_TOKENS
from roleledger.operators import similarity
from workload.views import view, with_views


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.tokenize(view(spark, sf_dir, "postings"))
    return found.select(
        "key_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.document_frequency(view(spark, sf_dir, "postings"))


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = similarity.tfidf_weights(view(spark, sf_dir, "postings"))
    return weights.select("key_id", "term", F.round("weight", 6).alias("weight"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "postings_incoming"), view(spark, sf_dir, "postings_master")


def similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.similarity_join(*_sides(spark, sf_dir))
    return pairs.withColumn("similarity", F.round("similarity", 6))


def similar_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of either side every key of the join stands for."""
    return similarity.similar_postings(*_sides(spark, sf_dir))[1]


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.best_match(*_sides(spark, sf_dir))
    return found.withColumn("similarity", F.round("similarity", 6))


def similarity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similarity_gate(*_sides(spark, sf_dir))


def self_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "postings").withColumn("ordinal", F.col("doc_id"))
    found = similarity.self_similarity(rows)
    return found.withColumn("similarity", F.round("similarity", 6))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize, document_frequency, tfidf_weights, similarity_join, similar_postings, best_match, similarity_gate,
        self_similarity,
    )
}

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_TOKENS) + "]"
_WORDS = f"""list_filter(regexp_extract_all(strip_accents(lower(description)), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda w: NOT list_contains({_STOP}, w))"""


def weights_sql(rows: str) -> str:
    """Steps from ``rows(key_id, side, description)`` to ``weight(key_id, side, term, tf, w, norm)``."""
    return f"""described AS (SELECT key_id, side, description FROM ({rows}) r WHERE length(description) > 0),
word AS (SELECT key_id, side, unnest({_WORDS}) AS term FROM described),
counted AS (SELECT key_id, side, term, count(*) AS tf FROM word GROUP BY ALL),
frequency AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
total AS (SELECT count(*) AS n FROM described),
raw AS (SELECT key_id, side, term, tf, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM counted JOIN frequency USING (term), total),
norm AS (SELECT key_id, side, sqrt(sum(w * w)) AS norm FROM raw GROUP BY ALL),
weight AS (SELECT key_id, side, term, tf, w, norm FROM raw JOIN norm USING (key_id, side))"""


# Every pair that shares a word, scored in full: the plain definition.
PAIRS = """pair AS (SELECT a.key_id AS a_key, b.key_id AS b_key, sum(a.w * b.w) / (any_value(a.norm) * any_value(b.norm)) AS s
  FROM weight a JOIN weight b ON a.term = b.term AND a.side = 'in' AND b.side = 'ex' GROUP BY 1, 2),
similar_pair AS (SELECT * FROM pair WHERE s >= 0.75)"""

_TWO = weights_sql(
    "SELECT key_id, 'in' AS side, description FROM {postings_incoming} UNION ALL "
    "SELECT key_id, 'ex' AS side, description FROM {postings_master}"
)

# Interchangeable descriptions: the same counts of the words both sides use, and the same norm.
_GROUPED = """common AS (SELECT term FROM counted GROUP BY term HAVING count(DISTINCT side) = 2),
kind AS (SELECT key_id, side, round(any_value(norm), 6) AS norm,
  string_agg(concat(term, ':', tf), ' ' ORDER BY term) AS shared FROM weight JOIN common USING (term) GROUP BY key_id, side),
grouped AS (SELECT key_id, side, min(key_id) OVER (PARTITION BY side, norm, shared) AS first,
  count(*) OVER (PARTITION BY side, norm, shared) AS n FROM kind)"""

ORACLES = {
    name: with_views(sql)
    for name, sql in {
        "tokenize": f"""WITH t AS (SELECT key_id, {_WORDS} AS ws FROM {{postings}})
            SELECT key_id, CAST(len(ws) AS BIGINT) AS n_tokens, array_to_string(ws, ' ') AS tokens FROM t""",
        "document_frequency": f"""WITH {weights_sql("SELECT key_id, 'in' AS side, description FROM {postings}")}
            SELECT term, df, n AS n_docs FROM frequency, total""",
        "tfidf_weights": f"""WITH {weights_sql("SELECT key_id, 'in' AS side, description FROM {postings}")}
            SELECT key_id, term, round(w / norm, 6) AS weight FROM weight""",
        "similarity_join": f"""WITH {_TWO}, {PAIRS}, {_GROUPED}
            SELECT a.first AS incoming_key, b.first AS existing_key, round(s, 6) AS similarity, a.n AS n_incoming, b.n AS n_existing
            FROM similar_pair JOIN grouped a ON a.side = 'in' AND a.key_id = a_key AND a.first = a_key
            JOIN grouped b ON b.side = 'ex' AND b.key_id = b_key AND b.first = b_key""",
        "similar_postings": f"""WITH {_TWO}, {_GROUPED} SELECT side, key_id, first AS class_key_id FROM grouped""",
        "best_match": f"""WITH {_TWO}, {PAIRS},
            ranked AS (SELECT *, row_number() OVER (PARTITION BY a_key ORDER BY round(s, 9) DESC, b_key) AS place FROM similar_pair)
            SELECT b_key AS original_key_id, a_key AS duplicate_key_id, 'NEW_TFIDF' AS dup_type, round(s, 6) AS similarity
            FROM ranked WHERE place = 1""",
        "similarity_gate": """SELECT i AS n_incoming, e AS n_existing, i > 0 AND i + e >= 25 AS enabled
            FROM (SELECT count(*) AS i FROM {postings_incoming}) a, (SELECT count(*) AS e FROM {postings_master}) b""",
        "self_similarity": f"""WITH {weights_sql("SELECT key_id, 'in' AS side, description FROM {postings}")},
            numbered AS (SELECT w.*, doc_id FROM weight w JOIN {{postings}} p USING (key_id)),
            pair AS (SELECT a.key_id AS a_key, a.doc_id AS a_no, b.key_id AS b_key, sum(a.w * b.w) / (any_value(a.norm) * any_value(b.norm)) AS s
              FROM numbered a JOIN numbered b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY b_key ORDER BY a_no) AS place FROM pair WHERE s >= 0.75)
            SELECT a_key AS original_key_id, b_key AS duplicate_key_id, 'NEW_TFIDF' AS dup_type, round(s, 6) AS similarity
            FROM ranked WHERE place = 1""",
    }.items()
}
