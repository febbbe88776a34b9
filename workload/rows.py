"""Sources, normalisation and filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from roleledger.operators import filters, merge, normalize
from roleledger.scratch import fresh_path
from roleledger.sources import keyed_json, master_csv, pages as page_files, snapshots as snapshot_files
from workload.views import AS_OF, view, with_views

COMPANIES = ["Company 3", "Company 17"]
_COMPANIES_SQL = "('Company 3', 'Company 17')"


def day(name: str):
    return F.col(name).cast("string").alias(name)


def tagged(df: DataFrame) -> DataFrame:
    """Postings of the views with their tags as a list."""
    return normalize.split_tags(df, "tags_text", "tags").drop("tags_text")


# ---- sources -------------------------------------------------------------------------------


def page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_files.page_source(spark, f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", F.md5("html").alias("html_md5"))


def write_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master_csv.master_rows(tagged(view(spark, sf_dir, "postings")))


def read_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "master-csv")
    master_csv.write_master(tagged(view(spark, sf_dir, "postings")), path)
    read = master_csv.read_master(spark, path)
    return read.select(
        "key_id", "status", "title", "company", "location", day("post_date"), day("scrape_date"),
        F.md5("description").alias("description_md5"), F.array_join("tags", "|").alias("tags"),
        "url", "provider", "query", "locale", "wage", "remoteness",
    )


def block_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.block_entry(view(spark, sf_dir, "postings"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.block_entry(view(spark, sf_dir, "postings"))


def read_keyed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "block-list-json")
    keyed_json.write_keyed_json(_entries(spark, sf_dir), path)
    return keyed_json.read_keyed_json(spark, path, object_per_line=True)


def read_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings as one object, in one file or the parts of one, written and read in parallel."""
    path = fresh_path(spark, "block-list-object")
    keyed_json.write_json_object(_entries(spark, sf_dir), path)
    return keyed_json.read_keyed_json(spark, path)


def _written_snapshots(spark: SparkSession, sf_dir: str) -> str:
    root = fresh_path(spark, "snapshots")
    rows = view(spark, sf_dir, "snapshots")
    days = [dt.date(2024, 1, 29) + dt.timedelta(days=k) for k in range(3)]
    for k, date in enumerate(days):
        of_day = rows.where(F.col("snapshot_date") == F.lit(date)).drop("snapshot_date", "version")
        snapshot_files.write_snapshot(of_day, root, date, f"1.0.{k}")
    # The second day once more: it replaces that day and leaves the others.
    again = rows.where(F.col("snapshot_date") == F.lit(days[1])).drop("snapshot_date", "version")
    snapshot_files.write_snapshot(again.withColumn("status", F.lit("NEW")), root, days[1], "1.0.1")
    return root


def write_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = snapshot_files.read_snapshots(spark, _written_snapshots(spark, sf_dir))
    return stored.select("key_id", "title", "status", day("snapshot_date"), "version")


def read_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _written_snapshots(spark, sf_dir)
    found = snapshot_files.read_snapshot(spark, root, dt.date(2024, 1, 31))
    return found.select("key_id", "title", "status", day("snapshot_date"), "version")


def foreign_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_files.foreign_versions(view(spark, sf_dir, "snapshots"), "1.0.2")


# ---- normalisation -------------------------------------------------------------------------


def parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "postings_base")
    return normalize.parse_status(df, "status_text").select("key_id", "status")


def parse_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "searches_base").withColumn("text", F.concat(F.lit(" "), F.lower("locale")))
    return normalize.parse_locale(df, "text").select("search_id", "locale", "locale_reason")


def parse_remoteness(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "postings_base")
    return normalize.parse_remoteness(df, "remoteness_text").select("key_id", "remoteness", "remoteness_reason")


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.col("o_orderdate").cast("date")
    short = F.concat_ws("-", F.year(ordered).cast("string"), F.month(ordered).cast("string"), F.day(ordered).cast("string"))
    kind = F.col("o_orderkey") % 3
    df = view(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(kind == 0, short).when(kind == 1, ordered.cast("string")).otherwise("n/a").alias("post_date"),
        F.when(F.col("o_orderkey") % 2 == 0, ordered.cast("string")).alias("scrape_date"),
    )
    return normalize.parse_dates(df).select("o_orderkey", day("post_date"), day("scrape_date"))


def split_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tagged(view(spark, sf_dir, "postings"))
    return df.select("key_id", F.size("tags").cast("bigint").alias("n_tags"), F.array_join("tags", "|").alias("tags"))


def legacy_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = view(spark, sf_dir, "postings").select("key_id", "title", "post_date")
    return normalize.legacy_columns(old).select(
        "key_id", "title", "short_description", day("scrape_date"), "status", "locale", "remoteness", "wage"
    )


def clean_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = normalize.clean_strings(tagged(view(spark, sf_dir, "postings")))
    return df.select("key_id", "title", "description", F.array_join("tags", "|").alias("tags"))


# ---- filters -------------------------------------------------------------------------------


def drop_removed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_removed_status(view(spark, sf_dir, "postings")).select("key_id", "status")


def drop_blocked_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_blocked_company(view(spark, sf_dir, "postings"), COMPANIES).select("key_id", "company")


def drop_company_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule with the names in a table: the companies of the block list."""
    blocked = view(spark, sf_dir, "block_list").where("company IS NOT NULL")
    return filters.drop_blocked_company(view(spark, sf_dir, "postings"), blocked).select("key_id", "company")


def drop_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_old(view(spark, sf_dir, "postings"), AS_OF, 60).select("key_id", day("post_date"))


def drop_block_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.drop_block_listed(view(spark, sf_dir, "postings"), view(spark, sf_dir, "block_list"))
    return kept.select("key_id", "title")


def drop_known_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.drop_known_duplicates(view(spark, sf_dir, "postings"), view(spark, sf_dir, "duplicates"))
    return kept.select("key_id", "title")


def drop_wrong_remoteness(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.drop_wrong_remoteness(view(spark, sf_dir, "postings"), "FULLY_REMOTE")
    return kept.select("key_id", "remoteness")


def _rules(spark: SparkSession, sf_dir: str) -> dict:
    return {
        "as_of": AS_OF,
        "max_days": 60,
        "companies": COMPANIES,
        "block_list": view(spark, sf_dir, "block_list"),
        "duplicates": view(spark, sf_dir, "duplicates"),
        "wanted_remoteness": "FULLY_REMOTE",
    }


def filter_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.filter_postings(view(spark, sf_dir, "postings"), **_rules(spark, sf_dir))
    return kept.select("key_id", "status", "company", day("post_date"), "remoteness")


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filters.with_reject_reason(view(spark, sf_dir, "postings"), **_rules(spark, sf_dir))
    return judged.select("key_id", "reject_reason")


def validate_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = filters.validate_postings(view(spark, sf_dir, "postings"))
    return good.select("key_id", F.lit("").alias("invalid_reason")).unionByName(
        bad.select("key_id", "invalid_reason")
    )


def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = filters.required_fields(view(spark, sf_dir, "postings"))
    return good.select("key_id", F.lit("").alias("missing_field")).unionByName(
        bad.select("key_id", "missing_field")
    )


QUERIES = {
    f.__name__: f
    for f in (
        page_source, write_master, read_master, block_entry, read_keyed_json, read_json_object,
        write_snapshot, read_snapshot,
        foreign_versions, parse_status, parse_locale, parse_remoteness, parse_dates, split_tags,
        legacy_columns, clean_strings, drop_removed_status, drop_blocked_company, drop_company_table, drop_old,
        drop_block_listed, drop_known_duplicates, drop_wrong_remoteness, filter_postings, reject_reasons,
        validate_postings, required_fields,
    )
}

_REASON = f"""CASE WHEN status IN ('DELETE', 'ARCHIVE', 'REJECTED', 'OLD') THEN 'status'
    WHEN company IN {_COMPANIES_SQL} THEN 'company'
    WHEN post_date < DATE '2023-12-02' THEN 'age'
    WHEN key_id IN (SELECT key_id FROM {{block_list}}) THEN 'block list'
    WHEN key_id IN (SELECT key_id FROM {{duplicates}} WHERE dup_type IN ('NEW_TFIDF', 'EXISTING_TFIDF')) THEN 'known duplicate'
    WHEN remoteness NOT IN ('UNKNOWN', 'FULLY_REMOTE') THEN 'remoteness' END"""

_SNAPSHOT_ROWS = """SELECT key_id, title, CASE WHEN snapshot_date = DATE '2024-01-30' THEN 'NEW' ELSE status END AS status,
  CAST(snapshot_date AS VARCHAR) AS snapshot_date, version FROM {snapshots}"""

ORACLES = {
    name: with_views(sql)
    for name, sql in {
        "page_source": "SELECT page_id, url, md5(html) AS html_md5 FROM {pages}",
        "write_master": """SELECT status, title, company, location, strftime(post_date, '%Y-%m-%d') AS date,
            description AS blurb, tags_text AS tags, url AS link, key_id AS id, provider, query, locale, wage, remoteness
            FROM {postings}""",
        "read_master": """SELECT key_id, status, title, coalesce(company, '') AS company, location,
            CAST(post_date AS VARCHAR) AS post_date, CAST(post_date AS VARCHAR) AS scrape_date,
            md5(description) AS description_md5, replace(tags_text, chr(10), '|') AS tags, url, provider, query, locale,
            wage, remoteness FROM {postings}""",
        "block_entry": """SELECT key_id, title, company, strftime(post_date, '%Y-%m-%d') AS post_date,
            description,
            status FROM {postings}""",
        **dict.fromkeys(
            ["read_keyed_json", "read_json_object"],
            "SELECT key_id, title, company, strftime(post_date, '%Y-%m-%d') AS post_date, description, status FROM {postings}",
        ),
        "write_snapshot": _SNAPSHOT_ROWS,
        "read_snapshot": _SNAPSHOT_ROWS + " WHERE snapshot_date = DATE '2024-01-31'",
        "foreign_versions": "SELECT version, count(*) AS n_rows FROM {snapshots} WHERE version <> '1.0.2' GROUP BY version",
        "parse_status": """SELECT key_id, CASE WHEN upper(trim(status_text)) IN ('UNKNOWN', 'NEW', 'ARCHIVE', 'INTERVIEWING',
            'INTERVIEWED', 'REJECTED', 'ACCEPTED', 'DELETE', 'INTERESTED', 'APPLIED', 'APPLY', 'OLD')
            THEN upper(trim(status_text)) ELSE 'UNKNOWN' END AS status FROM {postings_base}""",
        "parse_locale": """SELECT search_id, locale, CASE WHEN locale IS NULL THEN 'unknown locale' END AS locale_reason
            FROM {searches_base}""",
        "parse_remoteness": """SELECT key_id, CASE WHEN remoteness_text = 'hybrid?' THEN 'UNKNOWN' ELSE remoteness_text END AS remoteness,
            CASE WHEN remoteness_text = 'hybrid?' THEN 'unknown remoteness' END AS remoteness_reason FROM {postings_base}""",
        "parse_dates": """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS p,
            CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS s FROM {orders})
            SELECT o_orderkey, CAST(p AS VARCHAR) AS post_date, CAST(coalesce(s, p) AS VARCHAR) AS scrape_date FROM d""",
        "split_tags": "SELECT key_id, CAST(2 AS BIGINT) AS n_tags, replace(tags_text, chr(10), '|') AS tags FROM {postings}",
        "legacy_columns": """SELECT key_id, title, '' AS short_description, CAST(post_date AS VARCHAR) AS scrape_date,
            'UNKNOWN' AS status, CAST(NULL AS VARCHAR) AS locale, 'UNKNOWN' AS remoteness, '' AS wage FROM {postings}""",
        "clean_strings": """SELECT key_id, title,
            regexp_replace(description, '[^\\x20-\\x7E\\t\\n\\r\\x0B\\x0C]', '', 'g') AS description,
            regexp_replace(replace(tags_text, chr(10), '|'), '[^\\x20-\\x7E\\t\\n\\r\\x0B\\x0C]', '', 'g') AS tags
            FROM {postings}""",
        "drop_removed_status": "SELECT key_id, status FROM {postings} WHERE status NOT IN ('DELETE', 'ARCHIVE', 'REJECTED', 'OLD')",
        "drop_blocked_company": f"SELECT key_id, company FROM {{postings}} WHERE company IS NULL OR company NOT IN {_COMPANIES_SQL}",
        "drop_company_table": """SELECT key_id, company FROM {postings} p WHERE NOT EXISTS
            (SELECT 1 FROM {block_list} b WHERE b.company = p.company)""",
        "drop_old": """SELECT key_id, CAST(post_date AS VARCHAR) AS post_date FROM {postings}
            WHERE post_date IS NULL OR post_date >= DATE '2023-12-02'""",
        "drop_block_listed": "SELECT key_id, title FROM {postings} WHERE key_id NOT IN (SELECT key_id FROM {block_list})",
        "drop_known_duplicates": """SELECT key_id, title FROM {postings} WHERE key_id NOT IN
            (SELECT key_id FROM {duplicates} WHERE dup_type IN ('NEW_TFIDF', 'EXISTING_TFIDF'))""",
        "drop_wrong_remoteness": "SELECT key_id, remoteness FROM {postings} WHERE remoteness IN ('UNKNOWN', 'FULLY_REMOTE')",
        "filter_postings": f"""SELECT key_id, status, company, CAST(post_date AS VARCHAR) AS post_date, remoteness
            FROM {{postings}} WHERE {_REASON} IS NULL""",
        "reject_reasons": f"SELECT key_id, {_REASON} AS reject_reason FROM {{postings}}",
        "validate_postings": """SELECT key_id, CASE WHEN coalesce(title, '') = '' THEN 'title unset'
            WHEN coalesce(company, '') = '' THEN 'company unset' WHEN length(description) < 5 THEN 'description too short'
            ELSE '' END AS invalid_reason FROM {postings}""",
        "required_fields": """SELECT key_id, CASE WHEN coalesce(title, '') = '' THEN 'title'
            WHEN coalesce(company, '') = '' THEN 'company' ELSE '' END AS missing_field FROM {postings}""",
    }.items()
}
