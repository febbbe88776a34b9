"""Key matches, merging, whole runs and their streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roleledger.operators import keys, merge, normalize, summary
from roleledger.plans import recover as recovery, refresh
from roleledger.scratch import fresh_path
from roleledger.sources.state import RunState
from roleledger.streaming import refresh as streaming
from workload.rows import COMPANIES, day
from workload.similar import PAIRS, weights_sql
from workload.views import AS_OF, view, with_views

RULES = refresh.Rules(as_of=AS_OF, companies=tuple(COMPANIES))


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "key_id", "status", "title", "company", "location", day("post_date"),
        F.md5("description").alias("description_md5"), "url", "provider", "wage", "remoteness",
    )


def _views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, name) for name in names]


def match_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.match_by_key(*_views(spark, sf_dir, "postings_incoming", "postings_master")).drop("similarity")


def match_known_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keys.match_known_duplicate(*_views(spark, sf_dir, "postings_incoming", "postings_master", "duplicates"))
    return found.drop("similarity")


def unmatched_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = keys.unmatched_incoming(*_views(spark, sf_dir, "postings_incoming", "postings_master", "duplicates"))
    return rest.select("key_id", "title")


def find_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming, master, duplicates = _views(spark, sf_dir, "postings_incoming", "postings_master", "duplicates")
    found = refresh.find_duplicates(master, incoming, duplicates, RULES)
    return found.withColumn("similarity", F.round("similarity", 6))


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "duplicate_keys")
    return keys.first_wins(rows, ["provider_rank", "page_no", "pos"]).select("key_id", "title", "provider")


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "duplicate_keys")
    return keys.last_wins(rows, ["page_no", "provider_rank", "pos"]).select("key_id", "title", "provider")


def cross_provider_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.cross_provider_keys(view(spark, sf_dir, "duplicate_keys"))


def union_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming, master = _views(spark, sf_dir, "postings_incoming", "postings_master")
    together = keys.union_providers([incoming, master, incoming.limit(0)])
    return together.select("key_id", "status", "title", day("post_date"))


def update_if_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    master, matches, incoming = _views(spark, sf_dir, "postings_master", "sample_matches", "postings_incoming")
    return _shown(merge.update_if_newer(normalize.dated(master), matches, normalize.dated(incoming)))


def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    master, incoming, matches = _views(spark, sf_dir, "postings_master", "postings_incoming", "sample_matches")
    return merge.append_new(master, incoming, matches).select("key_id", "status", "title", "wage")


def upsert_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert_duplicates(*_views(spark, sf_dir, "duplicates", "sample_matches", "postings_incoming"))


def extend_block_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.extend_block_list(*_views(spark, sf_dir, "block_list", "postings_master"))


def recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = recovery.recover(*_views(spark, sf_dir, "snapshots", "block_list", "duplicates"), RULES)
    return _shown(rebuilt)


def _run(spark: SparkSession, sf_dir: str, counts: summary.RunCounts | None = None) -> refresh.Refreshed:
    return refresh.refresh_master(
        *_views(spark, sf_dir, "postings_master", "postings_incoming", "block_list", "duplicates"), RULES, counts=counts
    )


def refresh_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_run(spark, sf_dir).master)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = summary.RunCounts()
    done = _run(spark, sf_dir, counts)
    for table, name in ((done.master, "written"), (done.block_list, "blocked")):
        counts.all_rows(table, name).write.parquet(fresh_path(spark, name))
    return counts.summary(spark)


def _landed(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """The rows as files in a landing folder, one for each task that makes them, read back as a stream."""
    path = fresh_path(spark, "landed")
    rows.write.parquet(path)
    return streaming.landed_postings(spark, path, rows.schema)


def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master and then the collected rows, each landing as a batch of its own."""
    master, incoming = _views(spark, sf_dir, "postings_master", "postings_incoming")
    state, marks, landing = (fresh_path(spark, n) for n in ("state", "marks", "landing"))
    first = master.withColumn("ordinal", F.col("doc_id"))
    for rows in (first, incoming.select(*first.columns)):
        rows.write.mode("append").parquet(landing)
        stream = streaming.landed_postings(spark, landing, first.schema)
        streaming.stream_refresh(stream, state, marks, RULES).awaitTermination()
    done = RunState(spark, state)
    return _shown(done.read("master", done.latest_run()))


def stream_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of every key of a day, which is given out once a row of a later day has landed."""
    rows = view(spark, sf_dir, "duplicate_keys").withColumn("seen_at", F.col("scrape_date").cast("timestamp"))
    later = rows.limit(1).withColumns({"seen_at": F.expr("seen_at + interval 3 days"), "key_id": F.lit("later")})
    stream = streaming.stream_first_wins(
        _landed(spark, sf_dir, rows.unionByName(later)), "seen_at", "1 day", ("provider_rank", "page_no", "pos")
    )
    return _shown(_collected(spark, stream))


def stream_drop_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streaming.stream_drop_old(_landed(spark, sf_dir, view(spark, sf_dir, "postings")), AS_OF, 60)
    return _collected(spark, stream.select("key_id", day("post_date")))


def _collected(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out, marks = fresh_path(spark, "out"), fresh_path(spark, "marks")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


QUERIES = {
    f.__name__: f
    for f in (
        match_by_key, match_known_duplicate, unmatched_incoming, find_duplicates, first_wins, last_wins,
        cross_provider_keys, union_providers, update_if_newer, append_new, upsert_duplicates, extend_block_list,
        recover, refresh_master, run_summary, stream_refresh, stream_first_wins, stream_drop_old,
    )
}

_CONTENT = "dup_type IN ('NEW_TFIDF', 'EXISTING_TFIDF')"
_COLUMNS = """key_id, status, title, company, location, CAST(post_date AS VARCHAR) AS post_date, md5(description) AS description_md5,
    url, provider, wage, remoteness"""
_COMPANIES_SQL = "('Company 3', 'Company 17')"
_KEEP = f"""(company IS NULL OR company NOT IN {_COMPANIES_SQL}) AND (post_date IS NULL OR post_date >= DATE '2023-12-02')
    AND status NOT IN ('DELETE', 'ARCHIVE', 'REJECTED', 'OLD')"""
_ENTRY = """key_id, title, company, strftime(post_date, '%Y-%m-%d') AS post_date,
    description, status"""


def _matches(incoming: str, existing: str, duplicates: str = "{duplicates}") -> str:
    """Steps to ``found``: by key, by the duplicates list, and by text for the rest."""
    rest = (
        f"SELECT * FROM {incoming} WHERE key_id NOT IN (SELECT key_id FROM {existing}) "
        f"AND key_id NOT IN (SELECT key_id FROM {duplicates} d WHERE {_CONTENT})"
    )
    both = (
        f"SELECT key_id, 'in' AS side, description FROM ({rest}) q UNION ALL "
        f"SELECT key_id, 'ex' AS side, description FROM {existing}"
    )
    return f"""{weights_sql(both)}, {PAIRS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY a_key ORDER BY round(s, 9) DESC, b_key) AS place FROM similar_pair),
found AS (
  SELECT key_id AS original_key_id, key_id AS duplicate_key_id, 'KEY_ID' AS dup_type, CAST(NULL AS DOUBLE) AS similarity, 0 AS phase
  FROM {incoming} WHERE key_id IN (SELECT key_id FROM {existing})
  UNION ALL
  SELECT d.original_key_id, i.key_id, 'EXISTING_TFIDF', CAST(NULL AS DOUBLE), 1 FROM {incoming} i JOIN {duplicates} d ON d.key_id = i.key_id
  WHERE {_CONTENT} AND i.key_id NOT IN (SELECT key_id FROM {existing})
  UNION ALL
  SELECT b_key, a_key, 'NEW_TFIDF', s, 2 FROM ranked WHERE place = 1)"""


def _updated(matches: str, incoming: str, existing: str) -> str:
    """Steps to ``updated``, the rows on record after their newest match."""
    return f"""newest AS (SELECT m.original_key_id, i.*, row_number() OVER (PARTITION BY m.original_key_id
    ORDER BY i.post_date DESC, m.phase DESC, i.ordinal DESC) AS place
  FROM {matches} m JOIN {incoming} i ON i.key_id = m.duplicate_key_id WHERE m.original_key_id IS NOT NULL),
updated AS (SELECT e.key_id, e.status, e.title,
    CASE WHEN n.post_date >= e.post_date THEN n.company ELSE e.company END AS company,
    CASE WHEN n.post_date >= e.post_date THEN n.location ELSE e.location END AS location,
    CASE WHEN n.post_date >= e.post_date THEN n.post_date ELSE e.post_date END AS post_date,
    CASE WHEN n.post_date >= e.post_date THEN n.description ELSE e.description END AS description,
    CASE WHEN n.post_date >= e.post_date THEN n.url ELSE e.url END AS url,
    CASE WHEN n.post_date >= e.post_date THEN n.provider ELSE e.provider END AS provider,
    CASE WHEN n.post_date >= e.post_date THEN n.wage ELSE e.wage END AS wage,
    CASE WHEN n.post_date >= e.post_date THEN n.remoteness ELSE e.remoteness END AS remoteness
  FROM {existing} e LEFT JOIN newest n ON n.original_key_id = e.key_id AND n.place = 1)"""


_DATED = "SELECT * REPLACE (coalesce(post_date, scrape_date) AS post_date) FROM"
_BLOCKED = """SELECT key_id FROM {block_list} UNION SELECT key_id FROM {postings_master}
  WHERE status IN ('DELETE', 'ARCHIVE', 'REJECTED', 'OLD')"""


def _whole_run(blocked: str = _BLOCKED, duplicates: str = "{duplicates}") -> str:
    return f"""blocked AS ({blocked}),
arrived AS ({_DATED} {{postings_incoming}} WHERE {_KEEP} AND key_id NOT IN (SELECT key_id FROM blocked)),
known AS ({_DATED} {{postings_master}} WHERE {_KEEP} AND key_id NOT IN (SELECT key_id FROM blocked)),
{_matches("arrived", "known", duplicates)},
{_updated("found", "arrived", "known")},
final AS (SELECT key_id, status, title, company, location, post_date, description, url, provider, wage, remoteness FROM updated
  UNION ALL SELECT key_id, status, title, company, location, post_date, description, url, provider, wage, remoteness FROM arrived
  WHERE key_id NOT IN (SELECT duplicate_key_id FROM found))"""


def _pick(order: str) -> str:
    return f"""SELECT key_id, title, provider FROM (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY {order}) AS place
    FROM {{duplicate_keys}}) r WHERE place = 1"""



ORACLES = {
    name: with_views(sql)
    for name, sql in {
        "match_by_key": """SELECT key_id AS original_key_id, key_id AS duplicate_key_id, 'KEY_ID' AS dup_type
            FROM {postings_incoming} WHERE key_id IN (SELECT key_id FROM {postings_master})""",
        "match_known_duplicate": f"""SELECT d.original_key_id, i.key_id AS duplicate_key_id, 'EXISTING_TFIDF' AS dup_type
            FROM {{postings_incoming}} i JOIN {{duplicates}} d ON d.key_id = i.key_id
            WHERE {_CONTENT} AND i.key_id NOT IN (SELECT key_id FROM {{postings_master}})""",
        "unmatched_incoming": f"""SELECT key_id, title FROM {{postings_incoming}} WHERE key_id NOT IN (SELECT key_id FROM {{postings_master}})
            AND key_id NOT IN (SELECT key_id FROM {{duplicates}} WHERE {_CONTENT})""",
        "find_duplicates": f"""WITH {_matches("{postings_incoming}", "{postings_master}")}
            SELECT original_key_id, duplicate_key_id, dup_type, round(similarity, 6) AS similarity FROM found""",
        "first_wins": _pick("provider_rank, page_no, pos"),
        "last_wins": _pick("page_no DESC, provider_rank DESC, pos DESC"),
        "cross_provider_keys": """SELECT key_id, count(DISTINCT provider) AS n_providers FROM {duplicate_keys}
            GROUP BY key_id HAVING count(DISTINCT provider) > 1""",
        "union_providers": """SELECT key_id, status, title, CAST(post_date AS VARCHAR) AS post_date FROM {postings_incoming}
            UNION ALL SELECT key_id, status, title, CAST(post_date AS VARCHAR) FROM {postings_master}""",
        "update_if_newer": f"""WITH arrived AS ({_DATED} {{postings_incoming}}), known AS ({_DATED} {{postings_master}}),
            numbered AS (SELECT *, CASE dup_type WHEN 'KEY_ID' THEN 0 ELSE 2 END AS phase FROM {{sample_matches}}),
            {_updated("numbered", "arrived", "known")} SELECT {_COLUMNS} FROM updated""",
        "append_new": """SELECT key_id, status, title, wage FROM {postings_master} UNION ALL
            SELECT key_id, status, title, wage FROM {postings_incoming}
            WHERE key_id NOT IN (SELECT duplicate_key_id FROM {sample_matches})""",
        "upsert_duplicates": f"""SELECT key_id, title, company, post_date, description, status, dup_type, original_key_id FROM {{duplicates}}
            WHERE key_id NOT IN (SELECT duplicate_key_id FROM {{sample_matches}})
            UNION ALL SELECT {_ENTRY}, dup_type, original_key_id FROM {{postings_incoming}} i
            JOIN {{sample_matches}} m ON m.duplicate_key_id = i.key_id""",
        "extend_block_list": f"""SELECT key_id, title, company, post_date, description, status FROM {{block_list}} UNION ALL
            SELECT {_ENTRY} FROM {{postings_master}} WHERE status IN ('DELETE', 'ARCHIVE', 'REJECTED', 'OLD')
            AND key_id NOT IN (SELECT key_id FROM {{block_list}})""",
        "recover": f"""SELECT {_COLUMNS} FROM ({_DATED} (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY snapshot_date DESC) AS place
            FROM {{snapshots}}) r WHERE place = 1 AND {_KEEP} AND key_id NOT IN (SELECT key_id FROM {{block_list}})
            AND key_id NOT IN (SELECT key_id FROM {{duplicates}} WHERE {_CONTENT})) d""",
        "refresh_master": f"WITH {_whole_run()} SELECT {_COLUMNS} FROM final",
        "run_summary": f"""WITH {_whole_run()}, reasons AS (SELECT CASE WHEN company IN {_COMPANIES_SQL} THEN 'company'
              WHEN post_date < DATE '2023-12-02' THEN 'age' WHEN key_id IN (SELECT key_id FROM blocked) THEN 'block list' END AS reason
              FROM {{postings_incoming}})
            SELECT 'collected' AS stage, provider, '' AS reason, count(*) AS n_rows FROM {{postings_incoming}} GROUP BY provider
            UNION ALL SELECT 'rejected', '', reason, count(*) FROM reasons WHERE reason IS NOT NULL GROUP BY reason
            UNION ALL SELECT 'read', '', '', count(*) FROM {{postings_master}}
            UNION ALL SELECT 'written', '', '', count(*) FROM final
            UNION ALL SELECT 'blocked', '', '', count(*) FROM blocked
            UNION ALL SELECT 'duplicate', '', dup_type, count(*) FROM found GROUP BY dup_type""",
        # Both lists start empty, so nothing is blocked and no duplicate is known.
        "stream_refresh": f"""WITH nothing AS (SELECT * FROM {{duplicates}} WHERE false),
            {_whole_run("SELECT key_id FROM nothing", "nothing")} SELECT {_COLUMNS} FROM final""",
        "stream_first_wins": f"""SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY key_id
            ORDER BY provider_rank, page_no, pos) AS place FROM {{duplicate_keys}}) r WHERE place = 1""",
        "stream_drop_old": """SELECT key_id, CAST(post_date AS VARCHAR) AS post_date FROM {postings}
            WHERE post_date IS NULL OR post_date >= DATE '2023-12-02'""",
    }.items()
}
