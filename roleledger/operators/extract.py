"""From landed pages to posting rows.

All of it is projections in the JVM, except for ``attach_detail``, which joins the detail pages. Reject rows
before that join: the rules that need no detail page then spare the work.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from roleledger.functions.dates import relative_date
from roleledger.functions.html import (
    attribute,
    block_pattern,
    first_match,
    has_class,
    inner_text,
    unescaped,
    with_elements,
    with_text_by_id,
    without_tags,
)
from roleledger.operators.crawl import page_count
from roleledger.schema import LISTING_JSON, PAGE_SIZE
from roleledger.scratch import staged

# ---- Fixed values -------------------------------------------------------------------------
JOBCARDS_SCRIPT_ID = "mosaic-data"
JOBCARDS_KEY = "mosaic-provider-jobcards"
REMOTENESS_BY_TAG = {"remote": "FULLY_REMOTE", "hybrid work": "TEMPORARILY_REMOTE"}
SIDEBAR_KEYS = ["industries", "job type"]
DETAIL_ELEMENT_ID = {
    "INDEED": "jobDescriptionText",
    "GLASSDOOR": "JobDescriptionContainer",
    "MONSTER": "JobDescription",
}
# Where a site's listing keeps its fields: the element and its class, or an attribute.
LISTING_BLOCK = {"GLASSDOOR": ("li", "jl"), "MONSTER": ("div", "flex-row")}
# ---- End of fixed values ------------------------------------------------------------------


def split_listings(pages: DataFrame, tag: str, css_class: str | None = None) -> DataFrame:
    """One row per ``tag`` element of a page, with ``css_class`` if given: ``pos`` from 0 and ``fragment``, its HTML.

    An element ends at its own end tag, whatever it holds; one that holds others of its kind comes before them.
    """
    cut = with_elements(pages, "html", tag, None if css_class is None else has_class(css_class), "_blocks").drop("html")
    kept = [c for c in pages.columns if c != "html"]
    each = cut.select(*kept, F.posexplode_outer("_blocks").alias("pos", "fragment"))
    # The outer form, since for the inner one the optimizer would add a filter that cuts every page twice.
    return each.where(F.col("pos").isNotNull())


def _with_job_cards(pages: DataFrame) -> DataFrame:
    """``_script``, ``_json`` and ``results`` of a page, each null where it is not there.

    The JSON ends at the ``};`` that ends a line, not at one inside a text. JSON that is cut short
    would parse in part, so it counts only when the whole of it is well formed.
    """
    script = rf'(?is)<script[^>]*\bid="{JOBCARDS_SCRIPT_ID}"[^>]*>(.*?)</script>'
    assigned = rf'(?s)\["{JOBCARDS_KEY}"\]\s*=\s*(\{{.*?\}});[ \t]*(?:[\r\n]|$)'
    model = f"struct<metaData:struct<mosaicProviderJobCardsModel:struct<results:array<{LISTING_JSON.simpleString()}>>>>"
    none = F.lit("")
    df = pages.withColumn("_script", F.nullif(F.regexp_extract("html", script, 1), none))
    df = df.withColumn("_json", F.nullif(F.regexp_extract("_script", assigned, 1), none))
    parsed = F.from_json("_json", model)["metaData"]["mosaicProviderJobCardsModel"]["results"]
    well_formed = F.try_parse_json("_json").isNotNull()
    return df.withColumns({"_well_formed": well_formed, "results": F.when(well_formed, parsed)}).drop("html")


def embedded_json(pages: DataFrame) -> DataFrame:
    """Pages with ``results``, the listings of the JSON they embed, and ``reject_reason`` if they lack it."""
    reason = (
        F.when(F.col("_script").isNull(), "no script")
        .when(F.col("_json").isNull(), "no job cards")
        .when(~F.col("_well_formed"), "bad JSON")
        .when(F.coalesce(F.size("results"), F.lit(0)) < 1, "no results")
    )
    judged = _with_job_cards(pages).withColumn("reject_reason", reason)
    return judged.drop("_script", "_json", "_well_formed")


def embedded_json_rows(pages: DataFrame) -> DataFrame:
    """One row per listing of the embedded JSON: ``pos`` and ``listing``; pages without it give none."""
    cards = _with_job_cards(pages).drop("_script", "_json", "_well_formed")
    # The outer form, since for the inner one the optimizer would add a filter that parses every page
    # a second time.
    each = cards.select("*", F.posexplode_outer("results").alias("pos", "listing")).drop("results")
    return each.where(F.col("pos").isNotNull())


def json_fields(listings: DataFrame) -> DataFrame:
    """The fields of a ``listing`` struct as columns; a missing one is null."""
    listing = F.col("listing")
    kept = [c for c in listings.columns if c != "listing"]
    return listings.select(
        *kept,
        listing["displayTitle"].alias("title"),
        without_tags(listing["snippet"]).alias("description"),
        listing["company"].alias("company"),
        listing["formattedLocation"].alias("location"),
        listing["jobkey"].alias("key_id"),
        listing["formattedRelativeTime"].alias("age_text"),
        attribute_tags(listing["taxonomyAttributes"]).alias("tags"),
        wage_text(listing["extractedSalary"]).alias("wage"),
        remoteness_from_flag(listing["remoteLocation"]).alias("remoteness"),
    )


def attribute_tags(categories: Column) -> Column:
    """``Label words: a, b`` for every category that has attributes."""
    def one(category: Column) -> Column:
        label = F.replace(category["label"], F.lit("-"), F.lit(" "))
        labels = F.transform(category["attributes"], lambda a: a["label"])
        return F.concat(
            F.upper(F.substring(label, 1, 1)),
            F.lower(F.substring(label, 2, 1 << 30)),
            F.lit(": "),
            F.array_join(labels, ", "),
        )

    some = F.filter(categories, lambda c: F.coalesce(F.size(c["attributes"]), F.lit(0)) > 0)
    return F.coalesce(F.transform(some, one), F.array().cast("array<string>"))


def wage_text(salary: Column) -> Column:
    """``$min - $max type`` when both amounts are there and not zero, else an empty text."""
    def there(amount: Column) -> Column:
        return F.coalesce(amount.try_cast("double") != 0, F.lit(False))

    text = F.concat(
        F.lit("$"), salary["min"], F.lit(" - $"), salary["max"], F.lit(" "), F.coalesce(salary["type"], F.lit(""))
    )
    return F.when(there(salary["min"]) & there(salary["max"]), text).otherwise("")


def remoteness_from_flag(flag: Column) -> Column:
    return F.when(flag, "FULLY_REMOTE").otherwise("UNKNOWN")


def remoteness_from_tags(df: DataFrame) -> DataFrame:
    """Remoteness by the first tag that speaks of "remote"; without one the column stays as it is."""
    tag = F.get(F.filter("tags", lambda t: F.lower(t).contains("remote")), F.lit(0))
    word = F.lower(F.trim(F.element_at(F.split(tag, ":"), -1)))
    named = F.lit("UNKNOWN")
    for text, name in REMOTENESS_BY_TAG.items():
        named = F.when(word == text, name).otherwise(named)
    current = F.col("remoteness") if "remoteness" in df.columns else F.lit("UNKNOWN")
    return df.withColumn("remoteness", F.when(tag.isNotNull(), named).otherwise(current))


def page_fields(pages: DataFrame) -> DataFrame:
    """Title, language, first heading and link targets of a whole page."""
    html = F.col("html")
    links = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select(
        *[c for c in pages.columns if c != "html"],
        inner_text(first_match(html, block_pattern("title"))).alias("title"),
        first_match(html, r'(?is)<html[^>]*\slang="([^"]*)"').alias("lang"),
        inner_text(first_match(html, block_pattern("h1"))).alias("heading"),
        links.alias("links"),
    )


def glassdoor_fields(listings: DataFrame, domain: Column) -> DataFrame:
    """Fields of a Glassdoor listing ``fragment``."""
    html = F.col("fragment")
    link = first_match(html, block_pattern("div", "logoWrap"))
    return listings.select(
        *[c for c in listings.columns if c != "fragment"],
        attribute(html, "data-normalize-job-title").alias("title"),
        inner_text(first_match(html, block_pattern("div", "jobEmpolyerName"))).alias("company"),
        attribute(html, "data-job-loc").alias("location"),
        attribute(html, "data-id").alias("key_id"),
        inner_text(first_match(html, block_pattern("div", "css-mi55ob"))).alias("age_text"),
        F.coalesce(inner_text(first_match(html, block_pattern("span", "salary"))), F.lit("")).alias("wage"),
        detail_url("GLASSDOOR", domain, attribute(link, "href")).alias("url"),
    )


def monster_fields(listings: DataFrame) -> DataFrame:
    """Fields of a Monster listing ``fragment``."""
    html = F.col("fragment")
    heading = first_match(html, block_pattern("h2", "title"))
    bypass = first_match(html, r'(?is)(<a\s[^>]*\bdata-bypass="true"[^>]*>)')
    return listings.select(
        *[c for c in listings.columns if c != "fragment"],
        attribute(heading, "data-m_impr_j_postingid").alias("key_id"),
        inner_text(heading).alias("title"),
        inner_text(first_match(html, block_pattern("div", "company"))).alias("company"),
        inner_text(first_match(html, block_pattern("div", "location"))).alias("location"),
        inner_text(first_match(html, block_pattern("time"))).alias("age_text"),
        attribute(bypass, "href").alias("url"),
    )


def monster_wage(detail_html: Column) -> Column:
    """Text of the first cell's inner ``div`` on a Monster detail page, else an empty text."""
    cell = r'(?is)<div\s[^>]*\bclass="col-xs-12 cell"[^>]*>\s*<div(?:\s[^>]*)?>(.*?)</div\s*>'
    return F.coalesce(inner_text(first_match(detail_html, cell)), F.lit(""))


def sidebar_tags(detail_html: Column) -> Column:
    """Values of the side panel whose key is one of those that make tags."""
    sections = F.regexp_extract_all(detail_html, F.lit(block_pattern("section", "summary-section")), F.lit(1))
    pairs = F.transform(
        sections,
        lambda s: F.struct(
            F.lower(inner_text(first_match(s, block_pattern("dt")))).alias("key"),
            inner_text(first_match(s, block_pattern("dd"))).alias("value"),
        ),
    )
    kept = F.filter(pairs, lambda p: F.coalesce(p["key"].isin(*SIDEBAR_KEYS) & p["value"].isNotNull(), F.lit(False)))
    return F.coalesce(F.transform(kept, lambda p: p["value"]), F.array().cast("array<string>"))


# Addresses up to which they are sent to all tasks: some 100 MB at most.
MAX_BROADCAST_URLS = 500_000


def _wanted_pages(pages: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """The pages whose address is in ``wanted``, a staged table, as far as that needs no shuffle."""
    if wanted is not None and wanted.count() <= MAX_BROADCAST_URLS:
        pages = pages.join(F.broadcast(wanted), "url", "left_semi")
    return pages.where("url is not null").select("url", "html")


def _urls(postings: DataFrame) -> DataFrame:
    return staged(postings.select("url").where("url is not null").distinct(), "urls")


def detail_text(pages: DataFrame, element_id: str, wanted: DataFrame | None = None) -> DataFrame:
    """``url`` and ``detail``, the text of one element of the page, once per address.

    ``wanted``, a staged table of addresses, says which pages count. Few addresses are broadcast, so that the
    other pages are not even cut; with many, the text is taken out before anything is shuffled, so whole pages
    never travel.
    """
    cut = with_text_by_id(_wanted_pages(pages, wanted), "html", element_id, "detail").select("url", "detail")
    return cut.groupBy("url").agg(F.min("detail").alias("detail"))


def attach_detail(postings: DataFrame, pages: DataFrame, element_id: str) -> DataFrame:
    """Postings with the description of their own page; without such a page they keep the one they have."""
    return (
        postings.join(detail_text(pages, element_id, _urls(postings)), "url", "left")
        .withColumn("description", F.coalesce("detail", "description"))
        .drop("detail")
        .select(*postings.columns)
    )


def attach_monster_detail(postings: DataFrame, pages: DataFrame, element_id: str) -> DataFrame:
    """As ``attach_detail``, with the wage and the tags that Monster shows on a posting's own page only."""
    cut = with_text_by_id(_wanted_pages(pages, _urls(postings)), "html", element_id, "detail")
    found = F.struct("detail", monster_wage(F.col("html")).alias("wage"), sidebar_tags(F.col("html")).alias("tags"))
    details = cut.select("url", found.alias("_own")).groupBy("url").agg(F.min("_own").alias("_own"))
    own = F.col("_own")
    return postings.join(details, "url", "left").withColumns(
        {
            "description": F.coalesce(own["detail"], "description"),
            "wage": F.coalesce(F.nullif(own["wage"], F.lit("")), "wage"),
            "tags": F.when(F.size(own["tags"]) > 0, own["tags"]).otherwise(F.col("tags")),
        }
    ).select(*postings.columns)


def with_post_date(df: DataFrame, as_of: dt.datetime, german: bool = False) -> DataFrame:
    """``post_date`` from ``age_text``. A text that names no day falls back to the day of collection,
    and ``post_date_inferred`` says so."""
    found = relative_date(F.col("age_text"), F.lit(as_of).cast("timestamp_ntz"), german)
    return df.withColumns(
        {"post_date": F.coalesce(found, F.lit(as_of.date())), "post_date_inferred": found.isNull()}
    )


def detail_url(provider: str, domain: Column, part: Column) -> Column:
    """Address of a posting's own page: from its key at Indeed, from a link within the site at Glassdoor."""
    if provider == "INDEED":
        return F.concat(F.lit("https://www.indeed."), domain, F.lit("/m/viewjob?jk="), part)
    if provider == "GLASSDOOR":
        return F.concat(F.lit("https://www.glassdoor."), domain, part)
    return part


def prefix_key(df: DataFrame) -> DataFrame:
    """``provider_key``; a missing key stays missing."""
    return df.withColumn("key_id", F.concat(F.col("provider"), F.lit("_"), F.col("key_id")))


def defaults_filled(df: DataFrame) -> DataFrame:
    """Empty values for what was not found."""
    empty = F.lit("")
    defaults = {
        "status": F.lit("NEW"),
        "remoteness": F.lit("UNKNOWN"),
        "short_description": empty,
        "description": empty,
        "wage": empty,
        "title": empty,
        "company": empty,
        "location": empty,
        "url": empty,
        "tags": F.array().cast("array<string>"),
    }
    return df.withColumns({n: F.coalesce(F.col(n), v) if n in df.columns else v for n, v in defaults.items()})


def fill_defaults(df: DataFrame, locale: str, query: str, provider: str) -> DataFrame:
    """The columns of a posting that collection sets, and empty values for what was not found."""
    fixed = {"locale": F.lit(locale), "query": F.lit(query), "provider": F.lit(provider)}
    return defaults_filled(df).withColumns(fixed)


def result_count(text: Column, locale: str) -> Column:
    """Number of hits in a page's heading, such as "1,234 jobs"; 0 without one.

    French and German headings name the page first and the hits second. Blanks of every kind count
    as blanks there.
    """
    if locale in ("FRANCE_FRENCH", "GERMANY_GERMAN"):
        mark = "." if locale == "GERMANY_GERMAN" else ","
        plain = F.replace(F.regexp_replace(text, r"[\x{A0}\x{2007}\x{202F}]", " "), F.lit(mark), F.lit(""))
        pattern = r"(\d+)" if locale == "GERMANY_GERMAN" else r"(\d+) "
        number = F.get(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), F.lit(1))
    else:
        number = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(\d+)\+?\s+jobs", 1)
    return F.coalesce(F.when(number != "", number).try_cast("int"), F.lit(0))


def first_number(text: Column) -> Column:
    """First whole number of a text, thousands marks ignored; 0 without one."""
    number = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(\d+)", 1)
    return F.coalesce(F.when(number != "", number).try_cast("int"), F.lit(0))


def result_page_count(df: DataFrame, text: str, provider: str, locale: str) -> DataFrame:
    """Add ``n_pages``, the result pages that the hits in ``text`` fill."""

    hits = result_count(F.col(text), locale) if provider == "INDEED" else first_number(F.col(text))
    return df.withColumn("n_pages", page_count(hits, F.lit(PAGE_SIZE[provider])))
