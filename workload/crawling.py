"""From searches to result pages and their pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roleledger.operators import crawl
from roleledger.schema import PAGE_SIZE
from workload.views import view, with_views


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "searches_base")
    return df.withColumns(
        {
            "providers": F.split("providers_text", ","),
            "keywords": F.split("keywords_text", ","),
            "similar": F.col("similar_results"),
            "location_id": F.col("search_id") + 5000,
        }
    ).drop("providers_text", "keywords_text", "similar_results")


def _collectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by provider, as they are when their addresses are made."""
    ready = crawl.search_domain(crawl.search_defaults(_searches(spark, sf_dir)))
    return crawl.searches_providers(ready)[0]


def searches_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = crawl.searches_providers(_searches(spark, sf_dir))
    return good.select("search_id", "provider", "collector").unionByName(
        bad.select("search_id", "provider", F.lit("nobody").alias("collector"))
    )


def search_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.search_domain(_searches(spark, sf_dir)).select("search_id", "domain", "domain_reason")


def search_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = crawl.search_validate(crawl.search_domain(crawl.search_defaults(_searches(spark, sf_dir))))
    return good.select("search_id", F.lit("").alias("reject_reason")).unionByName(
        bad.select("search_id", "reject_reason")
    )


def query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.query_text(_collectable(spark, sf_dir)).select("search_id", "provider", "query", "query_part")


def quantize_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crawl.quantize_radius(_collectable(spark, sf_dir))
    return found.select("search_id", "provider", F.col("site_radius").cast("bigint").alias("site_radius"))


def search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.search_urls(_collectable(spark, sf_dir)).select("search_id", "provider", "search_url")


def frontier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = crawl.search_urls(_collectable(spark, sf_dir)).withColumn(
        "next_link", F.concat(F.lit("/Job/jobs-SRCH_KE"), F.col("search_id").cast("string"), F.lit("_IP2.htm"))
    )
    size = F.lit(None).cast("int")
    for provider, rows in PAGE_SIZE.items():
        size = F.when(F.col("provider") == provider, rows).otherwise(size)
    pages = crawl.frontier_pages(ready.withColumn("n_pages", crawl.page_count(F.col("n_results"), size)))
    return pages.select("search_id", "provider", F.col("page_no").cast("bigint").alias("page_no"), "page_url")


def _paced(pacing: crawl.Pacing):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        requests = view(spark, sf_dir, "orders").select(
            F.col("o_orderpriority").alias("host"), F.col("o_orderkey").alias("ordinal")
        )
        paced = crawl.pacing_offsets(requests, pacing)
        return paced.select(
            "host", "ordinal", "position", F.round("delay", 3).alias("delay"), F.round("offset", 3).alias("offset")
        )

    return query


QUERIES = {
    "searches_providers": searches_providers,
    "search_domain": search_domain,
    "search_validate": search_validate,
    "query_text": query_text,
    "quantize_radius": quantize_radius,
    "search_urls": search_urls,
    "frontier_pages": frontier_pages,
    "pacing_offsets": _paced(crawl.Pacing("LINEAR", 5.0, 1.0)),
    "pacing_constant": _paced(crawl.Pacing("CONSTANT", 5.0, 1.0)),
    "pacing_sigmoid": _paced(crawl.Pacing("SIGMOID", 5.0, 1.0)),
}

_DOMAIN = """coalesce(domain, CASE locale WHEN 'CANADA_ENGLISH' THEN 'ca' WHEN 'CANADA_FRENCH' THEN 'ca' WHEN 'USA_ENGLISH' THEN 'com'
    WHEN 'UK_ENGLISH' THEN 'co.uk' WHEN 'FRANCE_FRENCH' THEN 'fr' WHEN 'GERMANY_GERMAN' THEN 'de' END)"""

_EACH = """each_search AS (SELECT *, unnest(string_split(providers_text, ',')) AS provider FROM {searches_base}),
supported AS (SELECT *, CASE provider
    WHEN 'INDEED' THEN coalesce(locale IN ('CANADA_ENGLISH', 'USA_ENGLISH', 'UK_ENGLISH', 'FRANCE_FRENCH', 'GERMANY_GERMAN'), false)
    WHEN 'GLASSDOOR' THEN coalesce(locale IN ('CANADA_ENGLISH', 'USA_ENGLISH', 'UK_ENGLISH'), false)
    ELSE coalesce(locale IN ('CANADA_ENGLISH', 'USA_ENGLISH', 'UK_ENGLISH', 'FRANCE_FRENCH'), false) END AS ok FROM each_search)"""

_READY = (
    _EACH
    + f""",
steps(provider, unit, radii) AS (VALUES ('INDEED', 'km', [0, 5, 10, 15, 25, 50, 100]), ('INDEED', 'mi', [0, 5, 10, 15, 25, 50, 100]),
    ('GLASSDOOR', 'km', [0, 10, 20, 30, 50, 100, 200]), ('GLASSDOOR', 'mi', [0, 5, 10, 15, 25, 50, 100]),
    ('MONSTER', 'km', [0, 5, 10, 20, 50, 100]), ('MONSTER', 'mi', [0, 5, 10, 20, 30, 40, 50, 60, 75, 100, 150, 200])),
step AS (SELECT provider, unit, unnest(radii) AS step FROM steps),
wanted AS (SELECT *, coalesce(radius, 25) AS r, CASE WHEN locale = 'USA_ENGLISH' THEN 'mi' ELSE 'km' END AS unit FROM supported WHERE ok),
stepped AS (SELECT w.search_id, w.provider, w.unit, max(s.step) AS s FROM wanted w JOIN step s
    ON s.provider = w.provider AND s.unit = w.unit AND s.step <= w.r GROUP BY ALL),
radii AS (SELECT search_id, provider, CASE WHEN provider = 'GLASSDOOR' AND unit = 'km' THEN
    CASE s WHEN 0 THEN 0 WHEN 10 THEN 6 WHEN 20 THEN 12 WHEN 30 THEN 19 WHEN 50 THEN 31 WHEN 100 THEN 62 ELSE 124 END ELSE s END AS site_radius FROM stepped),
ready AS (SELECT w.*, site_radius, {_DOMAIN} AS dom, lower(city) AS town, string_split(keywords_text, ',') AS kw
    FROM wanted w JOIN radii USING (search_id, provider)),
urls AS (SELECT *, CASE provider
  WHEN 'INDEED' THEN concat(
    CASE locale WHEN 'GERMANY_GERMAN' THEN concat('https://', dom, '.indeed.com/jobs') WHEN 'CANADA_ENGLISH' THEN concat('https://www.indeed.', dom, '/m/jobs')
      WHEN 'USA_ENGLISH' THEN concat('https://www.indeed.', dom, '/m/jobs') ELSE concat('https://www.indeed.', dom, '/jobs') END,
    '?q=', array_to_string(kw, '+'), '&l=', replace(town, ' ', '+'),
    CASE locale WHEN 'CANADA_ENGLISH' THEN concat('%2C+', upper(province)) WHEN 'USA_ENGLISH' THEN concat('%2C+', upper(province))
      WHEN 'FRANCE_FRENCH' THEN concat('+%28', upper(province), '%29') ELSE '' END,
    '&radius=', site_radius, '&limit=20&filter=', CAST(similar_results AS INT),
    CASE remoteness WHEN 'FULLY_REMOTE' THEN '&remotejob=032b3046-06a3-4876-8dfd-474eb5e7ed11'
      WHEN 'TEMPORARILY_REMOTE' THEN '&remotejob=7e3167e4-ccb4-49cb-b761-9bae564a0a63' ELSE '' END)
  WHEN 'GLASSDOOR' THEN concat('https://www.glassdoor.', dom, '/Job/jobs.htm?clickSource=searchBtn&sc.keyword=', array_to_string(kw, '-'),
    '&locT=C&locId=', search_id + 5000, '&jobType=&radius=', site_radius)
  ELSE concat('https://www.monster.', dom, CASE locale WHEN 'FRANCE_FRENCH' THEN '/emploi/recherche/?' ELSE '/jobs/search/?' END, '{{page}}q=',
    replace(array_to_string(kw, '-'), ' ', '-'), '&where=', replace(town, ' ', '-'),
    CASE locale WHEN 'UK_ENGLISH' THEN '' ELSE concat('__2C-', coalesce(province, '')) END, '&rad=', site_radius) END AS search_url FROM ready)"""
)

_PLACED = """WITH placed AS (SELECT o_orderpriority AS host, o_orderkey AS ordinal,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS position,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM {orders}),
  curve AS (SELECT *, """


def _paced_sql(curve: str) -> str:
    return (
        _PLACED
        + curve
        + """ AS v FROM placed),
  delayed AS (SELECT host, ordinal, position, CASE WHEN position = 0 THEN 0.0::DOUBLE ELSE round(greatest(v, 1.0::DOUBLE), 3) END AS delay FROM curve)
  SELECT host, ordinal, position, delay,
    round(sum(delay) OVER (PARTITION BY host ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS "offset" FROM delayed"""
    )


ORACLES = {
    name: with_views(sql)
    for name, sql in {
        "searches_providers": f"""WITH {_EACH} SELECT search_id, provider,
            CASE WHEN ok THEN concat(lower(provider), '_', lower(locale)) ELSE 'nobody' END AS collector FROM supported""",
        "search_domain": f"""SELECT search_id, {_DOMAIN} AS domain,
            CASE WHEN domain IS NULL AND locale IS NULL THEN 'Unknown domain for locale: none' END AS domain_reason FROM {{searches_base}}""",
        "search_validate": f"""SELECT search_id, CASE WHEN province IS NULL THEN 'Province/State not set'
            WHEN coalesce(locale, '') = '' THEN 'Locale not set' WHEN max_listing_days < 1 THEN 'Cannot set max posting days < 1'
            WHEN {_DOMAIN} IS NULL THEN 'Domain not set' WHEN remoteness = 'UNKNOWN' THEN 'Remoteness is UNKNOWN!' ELSE '' END AS reject_reason
            FROM {{searches_base}}""",
        "query_text": f"""WITH {_EACH} SELECT search_id, provider, replace(keywords_text, ',', ' ') AS query,
            CASE provider WHEN 'INDEED' THEN replace(keywords_text, ',', '+') WHEN 'GLASSDOOR' THEN replace(keywords_text, ',', '-')
            ELSE replace(replace(keywords_text, ',', '-'), ' ', '-') END AS query_part FROM supported WHERE ok""",
        "quantize_radius": f"WITH {_READY} SELECT search_id, provider, CAST(site_radius AS BIGINT) AS site_radius FROM radii",
        "search_urls": f"WITH {_READY} SELECT search_id, provider, search_url FROM urls",
        "frontier_pages": f"""WITH {_READY},
            counted AS (SELECT *, CAST(ceil(n_results / CASE provider WHEN 'INDEED' THEN 20.0 WHEN 'GLASSDOOR' THEN 30.0 ELSE 25.0 END) AS BIGINT) AS n FROM urls),
            paged AS (SELECT *, unnest(range(1, n + 1)) AS page_no FROM counted)
            SELECT search_id, provider, page_no, CASE provider WHEN 'INDEED' THEN concat(search_url, '&start=', (page_no - 1) * 20)
            WHEN 'MONSTER' THEN replace(search_url, '{{page}}', CASE WHEN page_no > 1 THEN concat('page=', page_no, '&') ELSE '' END)
            ELSE CASE WHEN page_no = 1 THEN search_url ELSE concat('https://www.glassdoor.', dom, '/Job/jobs-SRCH_KE', search_id, '_IP', page_no, '.htm') END
            END AS page_url FROM paged""",
        "pacing_offsets": _paced_sql("CASE WHEN position < 25 THEN position / 5.0::DOUBLE ELSE 5.0::DOUBLE END"),
        "pacing_constant": _paced_sql(
            "CASE WHEN position < 8 THEN (5.0::DOUBLE - least(n, 8) / 5.0::DOUBLE) + position * 0.2::DOUBLE ELSE 5.0::DOUBLE END"
        ),
        "pacing_sigmoid": _paced_sql(
            "5.0::DOUBLE / (1 + exp(-(position / (4 * sqrt(5.0::DOUBLE)) - ln(20.0::DOUBLE))))"
        ),
    }.items()
}
