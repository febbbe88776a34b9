"""Posting tables as views on the given tables. The same SQL runs on Spark and on the checking engine."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

AS_OF = dt.date(2024, 1, 31)

# One posting per document.
POSTINGS_BASE = """
SELECT doc_id,
  concat(source, '_', doc_id) AS key_id,
  CASE doc_id % 15 WHEN 0 THEN 'NEW' WHEN 1 THEN ' applied ' WHEN 2 THEN 'Archive' WHEN 3 THEN 'REJECTED'
    WHEN 4 THEN 'interview' WHEN 5 THEN 'delete' WHEN 6 THEN 'OLD' WHEN 7 THEN '' ELSE 'Interested' END AS status_text,
  CASE WHEN doc_id % 97 = 0 THEN '' ELSE concat('Title ', doc_id) END AS title,
  CASE WHEN doc_id % 41 = 0 THEN NULL ELSE concat('Company ', doc_id % 23) END AS company,
  concat('City ', doc_id % 11) AS location,
  CASE WHEN doc_id % 53 = 0 THEN NULL ELSE DATE '2024-01-31' - CAST(doc_id % 80 AS INT) END AS post_date,
  DATE '2024-01-31' AS scrape_date,
  text AS description,
  concat('Job types: Full-time, Contract', chr(10), CASE doc_id % 4 WHEN 0 THEN 'Remote: Remote'
    WHEN 1 THEN 'Remote: Hybrid work' WHEN 2 THEN 'Remote: Remote, Hybrid work' ELSE 'Benefits: Dental' END) AS tags_text,
  concat('https://jobs.example.com/view?jk=', doc_id) AS url,
  source AS provider, lang AS locale_text,
  CASE doc_id % 6 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'IN_PERSON' WHEN 2 THEN 'TEMPORARILY_REMOTE'
    WHEN 3 THEN 'PARTIALLY_REMOTE' WHEN 4 THEN 'FULLY_REMOTE' ELSE 'hybrid?' END AS remoteness_text
FROM {documents}
"""

# The columns of a posting, typed; the operators that parse are checked on the texts above.
_TYPED = """doc_id, key_id,
  CASE WHEN upper(trim(status_text)) IN ('NEW', 'APPLIED', 'ARCHIVE', 'REJECTED', 'DELETE', 'OLD', 'INTERESTED')
    THEN upper(trim(status_text)) ELSE 'UNKNOWN' END AS status,
  title, company, location, post_date, scrape_date, description, '' AS short_description, tags_text, url, provider,
  'engineer spark' AS query, 'CANADA_ENGLISH' AS locale, concat('$', doc_id) AS wage,
  CASE WHEN remoteness_text = 'hybrid?' THEN 'UNKNOWN' ELSE remoteness_text END AS remoteness"""

# Every document is in one of the two: the even ones are on record, the odd ones come in, and one
# in ten comes in again with another date.
VIEWS = {
    "postings": f"SELECT {_TYPED} FROM {{postings_base}}",
    "postings_master": "SELECT * FROM {postings} WHERE doc_id % 2 = 0",
    "postings_incoming": """
SELECT doc_id, key_id, 'NEW' AS status, title, company, location,
  CASE WHEN doc_id % 2 = 1 THEN post_date WHEN doc_id % 20 = 0 THEN post_date + 5 ELSE post_date - 5 END AS post_date,
  scrape_date, description, short_description, tags_text, url, provider, query, locale,
  CASE WHEN doc_id % 2 = 1 THEN wage ELSE concat(wage, ' again') END AS wage,
  remoteness, doc_id AS ordinal
FROM {postings} WHERE doc_id % 2 = 1 OR doc_id % 10 = 0""",
    "block_list": """
SELECT key_id, title, company, CAST(post_date AS VARCHAR(10)) AS post_date, description, status
FROM {postings} WHERE doc_id % 31 = 0""",
    "duplicates": """
SELECT key_id, title, company, CAST(post_date AS VARCHAR(10)) AS post_date, description, status,
  CASE WHEN doc_id % 2 = 1 THEN 'NEW_TFIDF' ELSE 'KEY_ID' END AS dup_type,
  CASE WHEN doc_id % 2 = 1 THEN NULL ELSE key_id END AS original_key_id
FROM {postings} WHERE doc_id % 37 = 0""",
    "snapshots": " UNION ALL ".join(
        f"""
SELECT doc_id, key_id, status, concat(title, ' load {k}') AS title, company, location, post_date, scrape_date,
  description, short_description, tags_text, url, provider, query, locale, wage, remoteness,
  DATE '2024-01-29' + {k} AS snapshot_date, '1.0.{k}' AS version
FROM {{postings}} WHERE doc_id % {k + 1} = 0"""
        for k in range(3)
    ),
    # Key matches of the overlap, and several new postings that repeat the text of one on record.
    "sample_matches": """
SELECT key_id AS original_key_id, key_id AS duplicate_key_id, 'KEY_ID' AS dup_type, CAST(NULL AS DOUBLE) AS similarity
FROM {postings_incoming} WHERE doc_id % 2 = 0
UNION ALL
SELECT o.key_id, i.key_id, 'NEW_TFIDF', CAST(0.9 AS DOUBLE)
FROM {postings_incoming} i JOIN {postings_master} o ON o.doc_id = i.doc_id - i.doc_id % 6
WHERE i.doc_id % 2 = 1 AND i.doc_id % 6 < 5""",
    # Some keys on two pages, and some claimed by two providers.
    "duplicate_keys": """
SELECT *, 1 AS page_no, 1 AS provider_rank, doc_id AS pos FROM {postings}
UNION ALL
SELECT doc_id, key_id, status, concat(title, ' page 2') AS title, company, location, post_date, scrape_date,
  description, short_description, tags_text, url, provider, query, locale, wage, remoteness,
  2 AS page_no, 1 AS provider_rank, doc_id AS pos
FROM {postings} WHERE doc_id % 7 = 0
UNION ALL
SELECT doc_id, key_id, status, concat(title, ' other') AS title, company, location, post_date, scrape_date,
  description, short_description, tags_text, url, 'other' AS provider, query, locale, wage, remoteness,
  1 AS page_no, 2 AS provider_rank, doc_id AS pos
FROM {postings} WHERE doc_id % 101 = 0""",
    "searches_base": """
SELECT c_custkey AS search_id, concat('City ', c_nationkey) AS city,
  CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE concat('P', c_nationkey) END AS province,
  CASE c_custkey % 7 WHEN 0 THEN 'CANADA_ENGLISH' WHEN 1 THEN 'CANADA_FRENCH' WHEN 2 THEN 'USA_ENGLISH' WHEN 3 THEN 'UK_ENGLISH'
    WHEN 4 THEN 'FRANCE_FRENCH' WHEN 5 THEN 'GERMANY_GERMAN' ELSE NULL END AS locale,
  CASE c_custkey % 3 WHEN 0 THEN 'INDEED' WHEN 1 THEN 'INDEED,MONSTER' ELSE 'INDEED,GLASSDOOR,MONSTER' END AS providers_text,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey * 7 % 230 AS INT) END AS radius,
  CAST(c_custkey % 90 AS INT) AS max_listing_days,
  CASE WHEN c_custkey % 31 = 0 THEN 'xyz' ELSE NULL END AS domain,
  CASE c_custkey % 5 WHEN 0 THEN 'FULLY_REMOTE' WHEN 1 THEN 'TEMPORARILY_REMOTE' WHEN 2 THEN 'IN_PERSON'
    WHEN 3 THEN 'ANY' ELSE CASE WHEN c_custkey % 37 = 0 THEN 'UNKNOWN' ELSE 'ANY' END END AS remoteness,
  c_custkey % 2 = 0 AS similar_results,
  concat(lower(c_mktsegment), ',data lead') AS keywords_text, CAST(c_custkey * 13 % 400 AS INT) AS n_results
FROM {customer}""",
    "age_phrases": """
SELECT p_partkey AS id, concat(p_size, CASE p_partkey % 12 WHEN 0 THEN ' hours ago' WHEN 1 THEN '+ days ago'
  WHEN 2 THEN ' months ago' WHEN 3 THEN ' years ago' WHEN 4 THEN 'd' WHEN 5 THEN ' jours' WHEN 6 THEN ' mois'
  WHEN 7 THEN ' hr' WHEN 8 THEN ' heures' WHEN 9 THEN ' annee' WHEN 10 THEN ' Tagen' ELSE ' minutes' END) AS phrase
FROM {part}
UNION ALL SELECT -1, 'Today' UNION ALL SELECT -2, 'Just posted' UNION ALL SELECT -3, 'Yesterday'
UNION ALL SELECT -4, 'soon' UNION ALL SELECT -5, NULL""",
}

TABLES = ["customer", "part", "orders", "lineitem", "documents", "pages", "events"]


def _needs(sql: str) -> list[str]:
    names = ["postings_base", *VIEWS, *TABLES]
    return [n for n in names if "{" + n + "}" in sql]


def _sql_of(name: str) -> str:
    return POSTINGS_BASE if name == "postings_base" else VIEWS[name]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _sql_of(name)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _needs(sql)})


def with_views(sql: str) -> str:
    """The query as one statement that defines every view it names, as ``{view}``, up front."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text):
            if name not in TABLES and name not in order:
                visit(_sql_of(name))
                order.append(name)

    visit(sql)

    def plain(text: str) -> str:
        for name in _needs(text):
            text = text.replace("{" + name + "}", name)
        return text

    ctes = [f"{n} AS ({plain(_sql_of(n))})" for n in order]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
