"""From landed pages to validated postings: what the sites show becomes the incoming side of a run."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from roleledger.functions.html import inner_text, with_elements, has_class
from roleledger.operators import extract, registry
from roleledger.operators.crawl import page_count
from roleledger.operators.filters import with_invalid_reason, with_missing_field
from roleledger.operators.keys import cross_provider_keys, first_wins, union_providers
from roleledger.schema import DOMAIN_BY_LOCALE, PAGE_SIZE, POSTING, POSTING_COLUMNS
from roleledger.scratch import staged

# ---- Fixed values: the element with the number of hits on a site's first result page --------
HITS_ELEMENT = {"INDEED": ("div", "jobsearch-JobCountAndSortPane-jobCount"), "GLASSDOOR": ("p", "jobsCount"), "MONSTER": ("h2", "figure")}
NEXT_ELEMENT = ("li", "next")
# ---- End of fixed values ------------------------------------------------------------------


def _domain() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in DOMAIN_BY_LOCALE.items() for x in kv]), F.col("locale"))


def first_page_facts(pages: DataFrame) -> DataFrame:
    """Add ``n_pages``, ``next_link`` and ``count_reason`` to first result pages (``provider``, ``locale``, ``html``).

    What ``frontier_pages`` needs of a search. A page without a count, or without a number in it, has no pages, and
    ``count_reason`` says so. Only Glassdoor's later pages hang on the link, so only there it is read.
    """
    provider = F.col("provider")
    marked = pages.withColumn("_row", F.struct(*[c for c in pages.columns if c != "html"]))
    tag = F.lit(None).cast("string")
    for name, (element, _) in HITS_ELEMENT.items():
        tag = F.when(provider == name, element).otherwise(tag)
    cut = with_elements(marked, "html", tag, "|".join(f"(?:{has_class(c)})" for _, c in HITS_ELEMENT.values()), "_counts")
    cut = with_elements(cut.withColumn("_list", F.when(provider == "GLASSDOOR", F.lit(NEXT_ELEMENT[0]))), "html", F.col("_list"), has_class(NEXT_ELEMENT[1]), "_next")
    facts = cut.withColumns(
        {
            "_text": inner_text(F.get("_counts", F.lit(0))),
            "next_link": extract.attribute(F.regexp_substr(F.get("_next", F.lit(0)), F.lit(r"(?is)<a\s[^>]*>")), "href"),
        }
    )
    hits = extract.first_number(F.col("_text"))
    for locale in DOMAIN_BY_LOCALE:
        indeed = (provider == "INDEED") & (F.col("locale") == locale)
        hits = F.when(indeed, extract.result_count(F.col("_text"), locale)).otherwise(hits)
    size = F.element_at(F.create_map(*[F.lit(x) for kv in PAGE_SIZE.items() for x in kv]), provider)
    reason = F.when(F.col("_text").isNull(), "no count").when(hits == 0, "no hits")
    kept = [F.col(f"_row.{c}") for c in pages.columns if c != "html"]
    return facts.select(*kept, page_count(hits, size).alias("n_pages"), "next_link", reason.alias("count_reason"))


@dataclass(frozen=True)
class Collected:
    """``postings`` with ``ordinal``, ready for a run; ``rejected`` rows, and ``pages`` without listings, with their reason."""

    postings: DataFrame
    rejected: DataFrame
    pages: DataFrame


def _listed(pages: DataFrame, wanted: list[tuple[str, str]] | None) -> tuple[DataFrame, DataFrame]:
    """Rows of all pages, each read once by the extractor of its site, and the pages that nobody reads."""
    pair = F.struct("provider", "locale")
    carried = ["provider", "locale", "query", "page_no"]
    rows, known = [], F.lit(False)
    for extractor, pairs in registry.by_extractor(wanted).items():
        own = pair.isin(*[F.struct(F.lit(p), F.lit(q)) for p, q in pairs])
        known = known | own
        if extractor in (registry.indeed, registry.glassdoor, registry.monster):
            found = pages.where(own).select(*carried, _domain().alias("domain"), "html").transform(extractor).drop("domain")
        else:
            found = pages.where(own).transform(extractor)
        rows.append(found if "pos" in found.columns else found.withColumn("pos", F.lit(0)))
    unread = pages.where(~known).select(*carried, F.lit("no extractor").alias("reject_reason"))
    indeed = pages.where(F.col("provider") == "INDEED").where(known)
    empty = extract.embedded_json(indeed.select(*carried, "html")).where("reject_reason is not null").select(*carried, "reject_reason")
    return union_providers(rows), unread.unionByName(empty)


def _with_details(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Each site's postings with what their own pages add."""
    parts = []
    for provider, element in extract.DETAIL_ELEMENT_ID.items():
        own = rows.where(F.col("provider") == provider)
        if provider == "MONSTER":
            parts.append(extract.attach_monster_detail(own, details, element))
        else:
            parts.append(extract.attach_detail(own, details, element))
    others = rows.where(~F.col("provider").isin(*extract.DETAIL_ELEMENT_ID))
    return reduce(DataFrame.unionByName, [*parts, others])


def collect(
    pages: DataFrame, as_of: dt.datetime, details: DataFrame | None = None, german: bool = False,
    sites: list[tuple[str, str]] | None = None,
) -> Collected:
    """Postings of landed result pages (``provider``, ``locale``, ``query``, ``page_no``, ``html``).

    ``sites`` are the pairs of provider and locale to read, all that have an extractor if none are named.
    A row without a required field is set aside, as is one that fails validation once ``details`` (``url``,
    ``html``), the landed pages of single postings, have been taken in. Of several rows of a key the first page's
    counts, at Monster, whose later pages repeat the earlier ones, the last page's. Keys carry their provider; a
    key that two providers claim all the same stops the run.
    """
    listed, bad_pages = _listed(pages, sites)
    dated = extract.with_post_date(listed, as_of, german).withColumn("scrape_date", F.lit(as_of.date()))
    for name in POSTING_COLUMNS:
        if name not in dated.columns:
            dated = dated.withColumn(name, F.lit(None).cast(POSTING[name].dataType))
    judged = staged(with_missing_field(dated), "listed")
    good = judged.where("missing_field is null")
    place = F.struct("page_no", "pos")
    # A later page stands for an earlier one where its number counts backwards.
    turned = F.when(F.col("provider") == "MONSTER", F.struct((-F.col("page_no")).alias("page_no"), (-F.col("pos")).alias("pos"))).otherwise(place)
    keyed = extract.prefix_key(good).withColumn("_place", turned)
    twice = cross_provider_keys(keyed).select("key_id").limit(1).collect()
    if twice:
        raise ValueError(f"two providers claim the key {twice[0]['key_id']}")
    filled = extract.defaults_filled(first_wins(keyed, ["_place", "query", "locale", "url"]).drop("_place"))
    detailed = filled if details is None else _with_details(filled, details)
    finished = staged(with_invalid_reason(detailed).withColumn("ordinal", F.monotonically_increasing_id()), "collected")
    postings = finished.where("invalid_reason is null").select(*POSTING_COLUMNS, "ordinal")
    missing = judged.where("missing_field is not null").select("provider", "key_id", "title", "url", F.concat(F.lit("no "), "missing_field").alias("reason"))
    invalid = finished.where("invalid_reason is not null").select("provider", "key_id", "title", "url", F.col("invalid_reason").alias("reason"))
    return Collected(postings, missing.unionByName(invalid), bad_pages)
