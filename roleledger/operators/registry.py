"""Extractors by provider and locale: those of the known sites, and those that users add.

An extractor turns landed pages into posting rows. It is an ordinary function on DataFrames, applied with
``transform``, so the whole collection stays one plan. Sites that differ between locales only in their domain
share one extractor, which finds the domain in the pages' column ``domain``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from roleledger.operators import extract as sites
from roleledger.operators.filters import REQUIRED_FIELDS, required_fields
from roleledger.operators.keys import union_providers
from roleledger.schema import DOMAIN_BY_LOCALE

Extractor = Callable[[DataFrame], DataFrame]
_extractors: dict[tuple[str, str], Extractor] = {}

# ---- Fixed values: the locales in which a site can be collected ---------------------------
SITE_LOCALES = {
    "INDEED": ["CANADA_ENGLISH", "USA_ENGLISH", "UK_ENGLISH", "FRANCE_FRENCH", "GERMANY_GERMAN"],
    "GLASSDOOR": ["CANADA_ENGLISH", "USA_ENGLISH", "UK_ENGLISH"],
    "MONSTER": ["CANADA_ENGLISH", "USA_ENGLISH", "UK_ENGLISH", "FRANCE_FRENCH"],
}
# ---- End of fixed values ------------------------------------------------------------------


def indeed(pages: DataFrame) -> DataFrame:
    """Listings from the JSON that a page embeds."""
    rows = sites.json_fields(sites.embedded_json_rows(pages))
    url = sites.detail_url("INDEED", F.col("domain"), F.col("key_id"))
    return sites.remoteness_from_tags(rows.withColumn("url", url))


def glassdoor(pages: DataFrame) -> DataFrame:
    return sites.glassdoor_fields(sites.split_listings(pages, *sites.LISTING_BLOCK["GLASSDOOR"]), F.col("domain"))


def monster(pages: DataFrame) -> DataFrame:
    return sites.monster_fields(sites.split_listings(pages, *sites.LISTING_BLOCK["MONSTER"]))


def register_extractor(provider: str, locale: str, extractor: Extractor, replace: bool = False) -> None:
    if (provider, locale) in _extractors and not replace:
        raise ValueError(f"{provider} already has an extractor for {locale}")
    _extractors[provider, locale] = extractor


for _site, _extractor in (("INDEED", indeed), ("GLASSDOOR", glassdoor), ("MONSTER", monster)):
    for _locale in SITE_LOCALES[_site]:
        register_extractor(_site, _locale, _extractor)


def extractor_for(provider: str, locale: str) -> Extractor:
    if (provider, locale) not in _extractors:
        raise ValueError(f"no extractor for {provider} and {locale}")
    return _extractors[provider, locale]


def by_extractor(pairs: list[tuple[str, str]] | None = None) -> dict[Extractor, list[tuple[str, str]]]:
    """The pairs that each extractor serves, so that one pass over the pages serves them all; all pairs if none are named."""
    out: dict[Extractor, list[tuple[str, str]]] = {}
    for pair in _extractors if pairs is None else pairs:
        out.setdefault(extractor_for(*pair), []).append(pair)
    return out


def extract(pages: DataFrame, provider: str, locale: str) -> tuple[DataFrame, DataFrame]:
    """Complete rows of one provider, and the quarantine of rows without a required field."""
    if "domain" not in pages.columns and locale in DOMAIN_BY_LOCALE:
        pages = pages.withColumn("domain", F.lit(DOMAIN_BY_LOCALE[locale]))
    extractor = extractor_for(provider, locale)
    # The built-in ones name the address of a posting as a page names its own.
    own = extractor in (indeed, glassdoor, monster)
    rows = (pages.drop("url") if own else pages).transform(extractor)
    missing = [name for name in REQUIRED_FIELDS if name not in rows.columns]
    if missing:
        raise ValueError(f"the extractor of {provider} lacks the columns {missing}")
    return required_fields(rows)


def extract_all(pages: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Complete rows of all providers."""
    return union_providers([extract(df, *pair)[0] for pair, df in pages.items()])
