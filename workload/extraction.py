"""Page extraction, on the given pages and on result pages that Spark builds from the documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roleledger.functions.html import unescaped
from roleledger.operators import extract, registry
from roleledger.plans import collect as collection
from roleledger.plans.collect import collect
from workload.rows import day, tagged
from workload.views import view, with_views

NOW = dt.datetime(2024, 1, 31, 10, 30)


def _escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _listing() -> Column:
    """A posting as a site's JSON has it; the text comes with markup."""
    label = lambda *texts: F.array(*[F.struct(t.alias("label")) for t in texts])
    categories = F.array(
        F.struct(F.lit("job-types").alias("label"), label(F.lit("Full-time"), F.lit("Contract")).alias("attributes")),
        F.struct(F.lit("benefits").alias("label"), F.array().cast("array<struct<label:string>>").alias("attributes")),
        F.struct(F.lit("REMOTE").alias("label"), label(F.concat(F.lit("Mode "), F.col("doc_id") % 3)).alias("attributes")),
    )
    low = F.when(F.col("doc_id") % 5 == 0, "0").when(F.col("doc_id") % 5 == 1, None).otherwise(F.col("doc_id").cast("string"))
    salary = F.struct(low.alias("min"), (F.col("doc_id") + 10).cast("string").alias("max"), F.lit("hourly").alias("type"))
    return F.struct(
        F.col("title").alias("displayTitle"),
        F.concat(F.lit("<b>"), F.col("description"), F.lit("</b>")).alias("snippet"),
        F.col("company"),
        F.col("location").alias("formattedLocation"),
        F.col("doc_id").cast("string").alias("jobkey"),
        F.concat((F.col("doc_id") % 80).cast("string"), F.lit(" days ago")).alias("formattedRelativeTime"),
        (F.col("doc_id") % 2 == 0).alias("remoteLocation"),
        categories.alias("taxonomyAttributes"),
        F.when(F.col("doc_id") % 7 > 0, salary).alias("extractedSalary"),
    )


def json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages of twenty postings each, as a site would send them."""
    pages = (
        view(spark, sf_dir, "postings")
        .select(F.floor(F.col("doc_id") / 20).alias("page_no"), F.struct("doc_id", _listing().alias("listing")).alias("r"))
        .groupBy("page_no")
        .agg(F.sort_array(F.collect_list("r")).alias("rs"))
    )
    results = F.transform("rs", lambda r: r["listing"])
    model = F.struct(F.struct(F.struct(results.alias("results")).alias("mosaicProviderJobCardsModel")).alias("metaData"))
    html = F.concat(
        F.lit('<html><body><script>var a = {"b": 1};</script><script id="mosaic-data" type="text/javascript">'
              'window.mosaic.providerData["other"]={"x": 1};\nwindow.mosaic.providerData["mosaic-provider-jobcards"]='),
        F.to_json(model),
        F.lit(";\nwindow.mosaic.done={};\n</script></body></html>"),
    )
    return pages.select("page_no", html.alias("html"))


def embedded_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.embedded_json_rows(json_pages(spark, sf_dir))
    listing = F.col("listing")
    return found.select("page_no", F.col("pos").cast("bigint").alias("pos"), listing["jobkey"].alias("key_id"), F.md5(listing["snippet"]).alias("snippet_md5"))


def embedded_json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why pages are set aside: each way to be broken, on a share of the pages."""
    html, kind = F.col("html"), F.col("page_no") % 5
    broken = (
        F.when(kind == 0, F.replace(html, F.lit('id="mosaic-data"'), F.lit("")))
        .when(kind == 1, F.replace(html, F.lit("mosaic-provider-jobcards"), F.lit("elsewhere")))
        .when(kind == 2, F.replace(html, F.lit('{"metaData"'), F.lit('{"metaData')))
        .when(kind == 3, F.replace(html, F.lit('"results"'), F.lit('"none"')))
        .otherwise(html)
    )
    judged = extract.embedded_json(json_pages(spark, sf_dir).withColumn("html", broken))
    return judged.select("page_no", "reject_reason")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.json_fields(extract.embedded_json_rows(json_pages(spark, sf_dir)))
    return rows.select(
        "key_id", "title", F.md5("description").alias("description_md5"), "company", "location", "age_text",
        F.array_join("tags", "|").alias("tags"), "wage", "remoteness",
    )


def collected_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps from result pages to validated postings of one site."""
    rows = extract.json_fields(extract.embedded_json_rows(json_pages(spark, sf_dir)))
    rows = rows.withColumn("url", extract.detail_url("INDEED", F.lit("ca"), F.col("key_id")))
    rows = extract.with_post_date(extract.remoteness_from_tags(rows), NOW)
    rows = extract.prefix_key(extract.fill_defaults(rows, "CANADA_ENGLISH", "engineer spark", "INDEED"))
    return rows.select(
        "key_id", "status", "title", "company", "url", day("post_date"), "post_date_inferred", "remoteness", "locale",
        "query", "provider", "short_description",
    )


def split_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = extract.split_listings(view(spark, sf_dir, "pages"), "li")
    return items.select("page_id", F.col("pos").cast("bigint").alias("pos"), "fragment")


def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = extract.page_fields(view(spark, sf_dir, "pages"))
    return fields.select("page_id", "title", "lang", "heading", F.array_join("links", " ").alias("links"))


def character_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with references of every kind, some of them references to references."""
    text = F.concat(
        F.col("p_name"), F.lit(" Caf&eacute;s &#8217;"), F.lit("&#"), (F.col("p_size") + 200).cast("string"), F.lit("; &#x1F600; &amp;lt; &copy "),
        F.col("p_brand"), F.lit("&notit; & &bogus; &NotEqualTilde;&#128;"),
    )
    return view(spark, sf_dir, "part").select("p_partkey", unescaped(text).alias("text"))


def _glassdoor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    wage = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<span class="gray salary"> $'), key, F.lit(" &amp; up </span>"))).otherwise("")
    block = F.concat(
        F.lit('<li class="jl react" data-id="'), key, F.lit('" data-normalize-job-title="'), F.col("title"),
        F.lit('" data-job-loc="'), F.col("location"), F.lit('"><div class="logoWrap"><a href="/partner/'), key,
        F.lit('.htm?a=1&amp;b=2">x</a></div><div class="jobInfoItem jobEmpolyerName"> <b>'),
        F.coalesce("company", F.lit("")), F.lit("</b> </div>"), wage,
        F.lit('<div class="d-flex align-items-end pl-std css-mi55ob">'), (F.col("doc_id") % 40).cast("string"),
        F.lit("d</div></li>"),
    )
    return (
        view(spark, sf_dir, "postings")
        .groupBy(F.floor(F.col("doc_id") / 30).alias("page_no"))
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", block.alias("b")))).alias("bs"))
        .select("page_no", F.concat(F.lit("<html><ul>\n<li class=\"other\">ad</li>"), F.array_join("bs.b", "\n"), F.lit("</ul></html>")).alias("html"))
    )


def glassdoor_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = extract.split_listings(_glassdoor_pages(spark, sf_dir), *extract.LISTING_BLOCK["GLASSDOOR"])
    return extract.glassdoor_fields(listings, F.lit("co.uk")).drop("page_no").withColumn("pos", F.col("pos").cast("bigint"))


def _monster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    block = F.concat(
        F.lit('<div class="flex-row"><div class="mux-company"><h2 class="title"><a data-bypass="true" data-m_impr_j_postingid="'),
        key, F.lit('" href="https://jobs.example.com/'), key, F.lit('">'), F.col("title"),
        F.lit('</a></h2></div><div class="company"><span>'), F.coalesce("company", F.lit("")),
        F.lit('</span></div><div class="location"> '), F.col("location"),
        F.lit(' </div><time datetime="x">'), (F.col("doc_id") % 25).cast("string"), F.lit(" days ago</time></div>"),
    )
    return (
        view(spark, sf_dir, "postings")
        .groupBy(F.floor(F.col("doc_id") / 25).alias("page_no"))
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", block.alias("b")))).alias("bs"))
        .select("page_no", F.concat(F.lit('<html><div class="page">'), F.array_join("bs.b", "\n"), F.lit("</div></html>")).alias("html"))
    )


def monster_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = extract.split_listings(_monster_pages(spark, sf_dir), *extract.LISTING_BLOCK["MONSTER"])
    return extract.monster_fields(listings).drop("page_no").withColumn("pos", F.col("pos").cast("bigint"))


def _own_pages(spark: SparkSession, sf_dir: str, url: Column, element_id: str) -> DataFrame:
    """A posting's own page as a site has it, with what Monster shows beside the description."""
    html = F.concat(
        F.lit('<html><body><div class="col-xs-12 cell"> <div>$'), F.col("doc_id").cast("string"), F.lit(" an hour</div></div>"),
        F.lit(f'<div class="a" id="{element_id}"><div><p>'), _escaped(F.col("description")),
        F.lit('</p></div></div><section class="summary-section"><dl><dt>Job type</dt><dd>Caf&eacute; '), F.col("location"),
        F.lit("</dd></dl></section><div>footer</div></body></html>"),
    )
    return view(spark, sf_dir, "postings").where("doc_id % 9 > 0").select(url.alias("url"), html.alias("html"))


def _collected(spark: SparkSession, sf_dir: str, pages: DataFrame, provider: str, url: Column) -> DataFrame:
    named = pages.withColumns({"provider": F.lit(provider), "locale": F.lit("UK_ENGLISH"), "query": F.lit("engineer")})
    done = collect(named, NOW, _own_pages(spark, sf_dir, url, extract.DETAIL_ELEMENT_ID[provider]), sites=[(provider, "UK_ENGLISH")])
    good = done.postings.select(
        "key_id", "title", "company", "location", "url", day("post_date"), "wage", F.array_join("tags", "|").alias("tags"),
        F.md5("description").alias("description_md5"), F.lit("").alias("reason"),
    )
    none = F.lit(None).cast("string")
    bad = done.rejected.select(
        "key_id", "title", none.alias("company"), none.alias("location"), "url", none.alias("post_date"), none.alias("wage"), none.alias("tags"),
        none.alias("description_md5"), "reason",
    )
    return good.unionByName(bad)


def collected_indeed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages and single pages of a site to postings and rejects, by the registered extractor."""
    url = F.concat(F.lit("https://www.indeed.co.uk/m/viewjob?jk="), F.col("doc_id").cast("string"))
    return _collected(spark, sf_dir, json_pages(spark, sf_dir), "INDEED", url)


def collected_glassdoor(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://www.glassdoor.co.uk/partner/"), F.col("doc_id").cast("string"), F.lit(".htm?a=1&b=2"))
    return _collected(spark, sf_dir, _glassdoor_pages(spark, sf_dir), "GLASSDOOR", url)


def collected_monster(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://jobs.example.com/"), F.col("doc_id").cast("string"))
    return _collected(spark, sf_dir, _monster_pages(spark, sf_dir), "MONSTER", url)


def first_page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of result pages and the link to the next one, from the first page of every search at every site."""
    hits = F.when(F.col("n_results") > 0, F.col("n_results") * 11)
    grouped = F.format_number(hits, 0)
    searches = view(spark, sf_dir, "searches_base").select("search_id", "n_results")

    def first(provider: str, html: Column) -> DataFrame:
        return searches.select("search_id", F.lit(provider).alias("provider"), F.lit("UK_ENGLISH").alias("locale"), html.alias("html"))

    indeed = F.concat(F.lit('<div><div class="x jobsearch-JobCountAndSortPane-jobCount"><span>'), grouped, F.lit("+ jobs</span></div></div>"))
    glassdoor = F.concat(
        F.lit('<p class="jobsCount">&nbsp;'), grouped, F.lit(' Jobs</p><ul><li>1</li><li class="next"><a href="/Job/s-'),
        F.col("search_id").cast("string"), F.lit("_IP2.htm?a=1&amp;b\">Next</a></li></ul>"),
    )
    monster = F.concat(F.lit("<h2 class='figure'>("), grouped, F.lit(" Jobs Found)</h2>"))
    nothing = F.lit("<p>Something else</p>")
    pages = first("INDEED", F.coalesce(indeed, nothing)).unionByName(first("GLASSDOOR", F.coalesce(glassdoor, nothing)))
    facts = collection.first_page_facts(pages.unionByName(first("MONSTER", F.coalesce(monster, nothing))))
    return facts.drop("locale").withColumn("n_pages", F.col("n_pages").cast("bigint"))


def _detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(
        F.lit('<html><body><div id="top">menu</div><div class="a" id="jobDescriptionText"><div><p>'),
        _escaped(F.col("description")),
        F.lit("</p></div><div><br></div></div><div>footer</div></body></html>"),
    )
    return view(spark, sf_dir, "postings").select("url", html.alias("html"))


def attach_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting with its landed detail page, but for those whose page is not there."""
    postings = view(spark, sf_dir, "postings").withColumn("description", F.lit("none yet"))
    away = postings.withColumn("url", F.when(F.col("doc_id") % 9 == 0, F.concat("url", F.lit("&gone"))).otherwise(F.col("url")))
    pages = _detail_pages(spark, sf_dir)
    done = extract.attach_detail(away, pages, extract.DETAIL_ELEMENT_ID["INDEED"])
    return done.select("key_id", F.md5("description").alias("description_md5"))


def attribute_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda *names: F.array(*[F.struct(F.col(n).alias("label")) for n in names])
    none = F.array().cast("array<struct<label:string>>")
    even = F.col("p_size") % 2 == 0
    categories = F.array(
        F.struct(F.lit("job-types").alias("label"), label("p_type", "p_brand").alias("attributes")),
        F.struct(F.lit("ON-SITE work").alias("label"), F.when(even, none).otherwise(label("p_name")).alias("attributes")),
    )
    return view(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.attribute_tags(categories), "|").alias("tags"))


def sidebar_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = lambda key, value: F.concat(
        F.lit(f'<section class="summary-section"><dl><dt class="k"> {key} </dt><dd>'), value, F.lit("</dd></dl></section>")
    )
    html = F.concat(
        section("Job Type", F.col("p_type")), section("Posted", F.lit("today")), section("Industries", F.col("p_brand")),
        F.lit('<div class="col-xs-12 cell"> <div>'), F.col("p_retailprice").cast("int").cast("string"), F.lit(" an hour </div></div>"),
    )
    return view(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(extract.sidebar_tags(html), "|").alias("tags"), extract.monster_wage(html).alias("wage")
    )


def wage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice").cast("int").cast("string")
    low = F.when(F.col("p_partkey") % 5 == 0, "0").when(F.col("p_partkey") % 7 == 0, None).otherwise(price)
    salary = F.struct(
        low.alias("min"), F.col("p_size").cast("string").alias("max"), F.when(F.col("p_partkey") % 3 == 0, "yearly").alias("type")
    )
    return view(spark, sf_dir, "part").select("p_partkey", extract.wage_text(salary).alias("wage"))


def remoteness_from_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.remoteness_from_tags(tagged(view(spark, sf_dir, "postings"))).select("key_id", "remoteness")


def remoteness_from_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("doc_id") % 3 == 1)
    return view(spark, sf_dir, "postings").select("key_id", extract.remoteness_from_flag(flag).alias("remoteness"))


def relative_post_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = view(spark, sf_dir, "age_phrases").withColumnRenamed("phrase", "age_text")
    return extract.with_post_date(phrases, NOW).select("id", day("post_date"), "post_date_inferred")


def detail_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, domain = F.col("doc_id").cast("string"), F.lit("co.uk")
    return view(spark, sf_dir, "postings").select(
        "key_id",
        extract.detail_url("INDEED", domain, key).alias("indeed_url"),
        extract.detail_url("GLASSDOOR", domain, F.concat(F.lit("/job/"), key)).alias("glassdoor_url"),
    )


def prefix_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("doc_id") % 13 > 0, F.col("doc_id").cast("string"))
    return extract.prefix_key(view(spark, sf_dir, "postings").withColumn("key_id", key)).select("doc_id", "key_id")


def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "postings").select("key_id", "title", "company", "remoteness", "description")
    filled = extract.fill_defaults(found, "UK_ENGLISH", "data", "MONSTER")
    return filled.select(
        "key_id", "title", "company", "remoteness", "status", "short_description", "wage", "location", "url",
        F.array_join("tags", "|").alias("tags"), "locale", "query", "provider",
    )


def result_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same number of hits as the headings of four kinds of page show it."""
    hits = F.col("n_results") * 11
    def number(mark: str) -> Column:
        thousands, rest = F.floor(hits / 1000).cast("string"), F.lpad((hits % 1000).cast("string"), 3, "0")
        return F.when(hits >= 1000, F.concat(thousands, F.lit(mark), rest)).otherwise(hits.cast("string"))

    df = view(spark, sf_dir, "searches_base").select(
        "search_id",
        F.when(F.col("search_id") % 10 == 0, "no hits").otherwise(F.concat(number(","), F.lit("+ jobs"))).alias("english"),
        F.concat(F.lit("Page 1 de "), number(","), F.lit(" emplois")).alias("french"),
        F.concat(F.lit("Seite 1 von "), number("."), F.lit(" Jobs")).alias("german"),
        F.concat(number(","), F.lit(" Jobs")).alias("count_text"),
    )
    pages = lambda text, provider, locale: extract.result_page_count(
        df, text, provider, locale
    ).select("search_id", F.lit(f"{provider} {locale}").alias("page_kind"), F.col("n_pages").cast("bigint").alias("n_pages"))
    return (
        pages("english", "INDEED", "CANADA_ENGLISH")
        .unionByName(pages("french", "INDEED", "FRANCE_FRENCH"))
        .unionByName(pages("german", "INDEED", "GERMANY_GERMAN"))
        .unionByName(pages("count_text", "GLASSDOOR", "UK_ENGLISH"))
        .unionByName(pages("count_text", "MONSTER", "UK_ENGLISH"))
    )


def _example_site(pages: DataFrame) -> DataFrame:
    fields = extract.page_fields(pages)
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return fields.select(
        F.col("page_id").cast("string").alias("key_id"), F.col("heading").alias("title"), host.alias("company"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("location"), "url",
    )


def register_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site added by a user, with the rows that lack a field set aside."""
    registry.register_extractor("EXAMPLE", "UK_ENGLISH", _example_site, replace=True)
    good, bad = registry.extract(view(spark, sf_dir, "pages"), "EXAMPLE", "UK_ENGLISH")
    return good.withColumn("missing_field", F.lit("")).unionByName(bad)


QUERIES = {
    f.__name__: f
    for f in (
        embedded_json_rows, embedded_json_rejects, json_fields, collected_postings, split_listings, html_fields,
        character_references, glassdoor_fields, monster_fields, attach_detail, attribute_tags, sidebar_tags, wage_text,
        remoteness_from_tags, remoteness_from_flag, relative_post_date, detail_url, prefix_key, fill_defaults,
        result_page_count, register_extractor, collected_indeed, collected_glassdoor, collected_monster,
        first_page_facts,
    )
}

_TEXT = "regexp_replace(concat('<b>', description, '</b>'), '<[^>]+>', '', 'g')"
_JSON_WAGE = """CASE WHEN doc_id % 7 > 0 AND doc_id % 5 > 1 AND doc_id <> 0
    THEN concat('$', doc_id, ' - $', doc_id + 10, ' hourly') ELSE '' END"""
_INNER = """regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '^\\s+|\\s+$', '', 'g')"""
_TITLE = _INNER.format("regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1)")
_HEADING = _INNER.format("regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1\\s*>', 1)")
def _whole_site(provider: str, url: str, age: int, wage: str, tags: str, remote: str = "") -> str:
    return f"""WITH site AS (SELECT doc_id, title, coalesce(company, '') AS company, location, concat({url}) AS url,
          CAST(DATE '2024-01-31' - CAST(doc_id % {age} AS INT) AS VARCHAR) AS post_date, doc_id % 9 > 0 AS landed,
          regexp_replace(description, '^\\s+|\\s+$', '', 'g') AS detail, {wage} AS wage, {tags} AS tags, {_TEXT} AS snippet FROM {{postings}}),
        whole AS (SELECT *, CASE WHEN landed THEN detail ELSE {"snippet" if provider == "INDEED" else "''"} END AS d FROM site),
        judged AS (SELECT *, CASE WHEN title = '' THEN 'no title' WHEN company = '' THEN 'no company'
          WHEN length(d) < 5 THEN 'description too short' ELSE '' END AS reason FROM whole)
        SELECT CASE WHEN reason LIKE 'no %' THEN '' ELSE '{provider}_' END || doc_id AS key_id, title,
          CASE WHEN reason = '' THEN company END AS company, CASE WHEN reason = '' THEN location END AS location, url,
          CASE WHEN reason = '' THEN post_date END AS post_date, CASE WHEN reason = '' THEN wage END AS wage,
          CASE WHEN reason = '' THEN tags END AS tags, CASE WHEN reason = '' THEN md5(d) END AS description_md5, reason FROM judged"""


_AGE = """try_cast(nullif(regexp_extract(phrase, '(\\d+)[ +]{{0,3}}(?:{0})', 1), '') AS INTEGER)"""

ORACLES = {
    name: with_views(sql)
    for name, sql in {
        "embedded_json_rows": """SELECT doc_id // 20 AS page_no, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS pos,
            CAST(doc_id AS VARCHAR) AS key_id, md5(concat('<b>', description, '</b>')) AS snippet_md5 FROM {postings}""",
        "embedded_json_rejects": """SELECT DISTINCT doc_id // 20 AS page_no, CASE (doc_id // 20) % 5 WHEN 0 THEN 'no script'
            WHEN 1 THEN 'no job cards' WHEN 2 THEN 'bad JSON' WHEN 3 THEN 'no results' END AS reject_reason FROM {postings}""",
        "json_fields": f"""SELECT CAST(doc_id AS VARCHAR) AS key_id, title, md5({_TEXT}) AS description_md5, company, location,
            concat(doc_id % 80, ' days ago') AS age_text, concat('Job types: Full-time, Contract|Remote: Mode ', doc_id % 3) AS tags,
            {_JSON_WAGE} AS wage, CASE WHEN doc_id % 2 = 0 THEN 'FULLY_REMOTE' ELSE 'UNKNOWN' END AS remoteness FROM {{postings}}""",
        "collected_postings": """SELECT concat('INDEED_', doc_id) AS key_id, 'NEW' AS status, title, coalesce(company, '') AS company,
            concat('https://www.indeed.ca/m/viewjob?jk=', doc_id) AS url,
            CAST(DATE '2024-01-31' - CAST(doc_id % 80 AS INT) AS VARCHAR) AS post_date, false AS post_date_inferred,
            'UNKNOWN' AS remoteness, 'CANADA_ENGLISH' AS locale, 'engineer spark' AS query, 'INDEED' AS provider,
            '' AS short_description FROM {postings}""",
        "split_listings": """WITH f AS (SELECT page_id, regexp_extract_all(html, '(?is)<li(?:\\s[^>]*)?>(.*?)</li\\s*>') AS fs FROM {pages})
            SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, fs[i] AS fragment
            FROM (SELECT page_id, fs, unnest(range(1, len(fs) + 1)) AS i FROM f) g""",
        "html_fields": f"""SELECT page_id, {_TITLE} AS title, regexp_extract(html, '(?is)<html[^>]*\\slang="([^"]*)"', 1) AS lang,
            {_HEADING} AS heading, array_to_string(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1), ' ') AS links FROM {{pages}}""",
        "character_references": """SELECT p_partkey, concat(p_name, ' Cafés ’', chr(CAST(p_size + 200 AS INTEGER)), ' 😀 &lt; © ', p_brand,
            '¬it; & &bogus; ', chr(8770), chr(824), '€') AS text FROM {part}""",
        "glassdoor_fields": """SELECT row_number() OVER (PARTITION BY doc_id // 30 ORDER BY doc_id) - 1 AS pos, title,
            coalesce(company, '') AS company, location, CAST(doc_id AS VARCHAR) AS key_id, concat(doc_id % 40, 'd') AS age_text,
            CASE WHEN doc_id % 3 = 0 THEN concat('$', doc_id, ' & up') ELSE '' END AS wage,
            concat('https://www.glassdoor.co.uk/partner/', doc_id, '.htm?a=1&b=2') AS url FROM {postings}""",
        "monster_fields": """SELECT row_number() OVER (PARTITION BY doc_id // 25 ORDER BY doc_id) - 1 AS pos, title,
            coalesce(company, '') AS company, location, CAST(doc_id AS VARCHAR) AS key_id, concat(doc_id % 25, ' days ago') AS age_text,
            concat('https://jobs.example.com/', doc_id) AS url FROM {postings}""",
        "attach_detail": """SELECT key_id, md5(CASE WHEN doc_id % 9 = 0 THEN 'none yet'
            ELSE regexp_replace(description, '^\\s+|\\s+$', '', 'g') END) AS description_md5 FROM {postings}""",
        "collected_indeed": _whole_site(
            "INDEED", "'https://www.indeed.co.uk/m/viewjob?jk=', doc_id", 80, _JSON_WAGE, "concat('Job types: Full-time, Contract|Remote: Mode ', doc_id % 3)"
        ),
        "collected_glassdoor": _whole_site(
            "GLASSDOOR", "'https://www.glassdoor.co.uk/partner/', doc_id, '.htm?a=1&b=2'", 40,
            "CASE WHEN doc_id % 3 = 0 THEN concat('$', doc_id, ' & up') ELSE '' END", "''",
        ),
        "collected_monster": _whole_site(
            "MONSTER", "'https://jobs.example.com/', doc_id", 25, "CASE WHEN doc_id % 9 > 0 THEN concat('$', doc_id, ' an hour') ELSE '' END",
            "CASE WHEN doc_id % 9 > 0 THEN concat('Café ', location) ELSE '' END",
        ),
        "first_page_facts": """SELECT search_id, provider, CASE WHEN n_results > 0 THEN CAST(ceil(n_results * 11.0 / size) AS BIGINT) ELSE 0 END AS n_pages,
            CASE WHEN provider = 'GLASSDOOR' AND n_results > 0 THEN concat('/Job/s-', search_id, '_IP2.htm?a=1&b') END AS next_link,
            CASE WHEN n_results = 0 THEN 'no count' END AS count_reason
            FROM {searches_base}, (VALUES ('INDEED', 20), ('GLASSDOOR', 30), ('MONSTER', 25)) v(provider, size)""",
        "attribute_tags": """SELECT p_partkey, concat('Job types: ', p_type, ', ', p_brand,
            CASE WHEN p_size % 2 = 0 THEN '' ELSE concat('|On site work: ', p_name) END) AS tags FROM {part}""",
        "sidebar_tags": """SELECT p_partkey, concat(p_type, '|', p_brand) AS tags,
            concat(CAST(floor(p_retailprice) AS INT), ' an hour') AS wage FROM {part}""",
        "wage_text": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_size = 0 THEN ''
            ELSE concat('$', CAST(floor(p_retailprice) AS INT), ' - $', p_size, ' ', CASE WHEN p_partkey % 3 = 0 THEN 'yearly' ELSE '' END) END AS wage
            FROM {part}""",
        "remoteness_from_tags": """SELECT key_id, CASE doc_id % 4 WHEN 0 THEN 'FULLY_REMOTE' WHEN 1 THEN 'TEMPORARILY_REMOTE'
            WHEN 2 THEN 'UNKNOWN' ELSE remoteness END AS remoteness FROM {postings}""",
        "remoteness_from_flag": "SELECT key_id, CASE WHEN doc_id % 3 = 1 THEN 'FULLY_REMOTE' ELSE 'UNKNOWN' END AS remoteness FROM {postings}",
        "relative_post_date": f"""WITH n AS (SELECT id, phrase, {_AGE.format('hour|hr|heure')} AS h, {_AGE.format('day|d|jour')} AS d,
            {_AGE.format('month|mois')} AS m, {_AGE.format('year|annee')} AS y FROM {{age_phrases}}),
            f AS (SELECT id, CASE WHEN h IS NOT NULL THEN CAST(TIMESTAMP '2024-01-31 10:30:00' - to_hours(h) AS DATE)
            WHEN d IS NOT NULL THEN DATE '2024-01-31' - d
            WHEN m IS NOT NULL THEN CAST(DATE '2024-01-31' - to_months(m) AS DATE)
            WHEN y IS NOT NULL THEN CAST(DATE '2024-01-31' - to_months(12 * y) AS DATE)
            WHEN regexp_matches(phrase, '[tT]oday|[jJ]ust [pP]osted') THEN DATE '2024-01-31'
            WHEN regexp_matches(phrase, '[yY]esterday') THEN DATE '2024-01-30' END AS f FROM n)
            SELECT id, CAST(coalesce(f, DATE '2024-01-31') AS VARCHAR) AS post_date, f IS NULL AS post_date_inferred FROM f""",
        "detail_url": """SELECT key_id, concat('https://www.indeed.co.uk/m/viewjob?jk=', doc_id) AS indeed_url,
            concat('https://www.glassdoor.co.uk/job/', doc_id) AS glassdoor_url FROM {postings}""",
        "prefix_key": "SELECT doc_id, CASE WHEN doc_id % 13 > 0 THEN concat(provider, '_', doc_id) END AS key_id FROM {postings}",
        "fill_defaults": """SELECT key_id, title, coalesce(company, '') AS company, remoteness, 'NEW' AS status, '' AS short_description,
            '' AS wage, '' AS location, '' AS url, '' AS tags, 'UK_ENGLISH' AS locale, 'data' AS query, 'MONSTER' AS provider FROM {postings}""",
        "result_page_count": """WITH h AS (SELECT search_id, n_results * 11 AS h FROM {searches_base}),
            e AS (SELECT search_id, CASE WHEN search_id % 10 = 0 THEN 0 ELSE h END AS h FROM h)
            SELECT search_id, 'INDEED CANADA_ENGLISH' AS page_kind, CAST(ceil(h / 20.0) AS BIGINT) AS n_pages FROM e
            UNION ALL SELECT search_id, 'INDEED FRANCE_FRENCH', CAST(ceil(h / 20.0) AS BIGINT) FROM h
            UNION ALL SELECT search_id, 'INDEED GERMANY_GERMAN', CAST(ceil(h / 20.0) AS BIGINT) FROM h
            UNION ALL SELECT search_id, 'GLASSDOOR UK_ENGLISH', CAST(ceil(h / 30.0) AS BIGINT) FROM h
            UNION ALL SELECT search_id, 'MONSTER UK_ENGLISH', CAST(ceil(h / 25.0) AS BIGINT) FROM h""",
        "register_extractor": f"""WITH f AS (SELECT CAST(page_id AS VARCHAR) AS key_id, {_HEADING} AS title,
            regexp_extract(url, '^https?://([^/]+)', 1) AS company, regexp_extract(html, '(?is)<html[^>]*\\slang="([^"]*)"', 1) AS lang,
            url FROM {{pages}})
            SELECT key_id, title, company, CASE WHEN lang <> 'es' THEN lang END AS location, url,
            CASE WHEN title = '' THEN 'title' WHEN lang = 'es' THEN 'location' ELSE '' END AS missing_field FROM f""",
    }.items()
}
