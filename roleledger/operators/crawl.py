"""From a table of searches to the list of result pages to fetch, and how to pace the fetching."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from roleledger.operators.running import running_index, running_total
from roleledger.schema import DEFAULT_MAX_LISTING_DAYS, DEFAULT_RADIUS, DOMAIN_BY_LOCALE, PAGE_SIZE
from roleledger.scratch import staged

# ---- Fixed values -------------------------------------------------------------------------
# Sites and the locales they are collected for.
SUPPORTED = {
    "INDEED": ["CANADA_ENGLISH", "USA_ENGLISH", "UK_ENGLISH", "FRANCE_FRENCH", "GERMANY_GERMAN"],
    "GLASSDOOR": ["CANADA_ENGLISH", "USA_ENGLISH", "UK_ENGLISH"],
    "MONSTER": ["CANADA_ENGLISH", "USA_ENGLISH", "UK_ENGLISH", "FRANCE_FRENCH"],
}
# Radii that a site accepts, by the unit of its country.
RADIUS_STEPS = {
    ("INDEED", "km"): [0, 5, 10, 15, 25, 50, 100],
    ("INDEED", "mi"): [0, 5, 10, 15, 25, 50, 100],
    ("GLASSDOOR", "km"): [0, 10, 20, 30, 50, 100, 200],
    ("GLASSDOOR", "mi"): [0, 5, 10, 15, 25, 50, 100],
    ("MONSTER", "km"): [0, 5, 10, 20, 50, 100],
    ("MONSTER", "mi"): [0, 5, 10, 20, 30, 40, 50, 60, 75, 100, 150, 200],
}
# This site wants kilometres turned into miles.
GLASSDOOR_KM_TO_MILES = {0: 0, 10: 6, 20: 12, 30: 19, 50: 31, 100: 62, 200: 124}
MILE_LOCALES = ["USA_ENGLISH"]
# What to search for, as the site's address wants it. Glassdoor wants the id of the place, which a
# caller looks up beforehand.
URL_TEMPLATES = {
    ("INDEED", "CANADA_ENGLISH"): "https://www.indeed.{domain}/m/jobs?q={query}&l={city}%2C+{REGION}&radius={radius}&limit={limit}&filter={similar}{remote}",
    ("INDEED", "USA_ENGLISH"): "https://www.indeed.{domain}/m/jobs?q={query}&l={city}%2C+{REGION}&radius={radius}&limit={limit}&filter={similar}{remote}",
    ("INDEED", "UK_ENGLISH"): "https://www.indeed.{domain}/jobs?q={query}&l={city}&radius={radius}&limit={limit}&filter={similar}{remote}",
    ("INDEED", "FRANCE_FRENCH"): "https://www.indeed.{domain}/jobs?q={query}&l={city}+%28{REGION}%29&radius={radius}&limit={limit}&filter={similar}{remote}",
    ("INDEED", "GERMANY_GERMAN"): "https://{domain}.indeed.com/jobs?q={query}&l={city}&radius={radius}&limit={limit}&filter={similar}{remote}",
    ("GLASSDOOR", "CANADA_ENGLISH"): "https://www.glassdoor.{domain}/Job/jobs.htm?clickSource=searchBtn&sc.keyword={query}&locT=C&locId={location_id}&jobType=&radius={radius}",
    ("GLASSDOOR", "USA_ENGLISH"): "https://www.glassdoor.{domain}/Job/jobs.htm?clickSource=searchBtn&sc.keyword={query}&locT=C&locId={location_id}&jobType=&radius={radius}",
    ("GLASSDOOR", "UK_ENGLISH"): "https://www.glassdoor.{domain}/Job/jobs.htm?clickSource=searchBtn&sc.keyword={query}&locT=C&locId={location_id}&jobType=&radius={radius}",
    ("MONSTER", "CANADA_ENGLISH"): "https://www.monster.{domain}/jobs/search/?{page}q={query}&where={city}__2C-{region}&rad={radius}",
    ("MONSTER", "USA_ENGLISH"): "https://www.monster.{domain}/jobs/search/?{page}q={query}&where={city}__2C-{region}&rad={radius}",
    ("MONSTER", "UK_ENGLISH"): "https://www.monster.{domain}/jobs/search/?{page}q={query}&where={city}&rad={radius}",
    ("MONSTER", "FRANCE_FRENCH"): "https://www.monster.{domain}/emploi/recherche/?{page}q={query}&where={city}__2C-{region}&rad={radius}",
}
REMOTE_CODES = {
    "TEMPORARILY_REMOTE": "&remotejob=7e3167e4-ccb4-49cb-b761-9bae564a0a63",
    "FULLY_REMOTE": "&remotejob=032b3046-06a3-4876-8dfd-474eb5e7ed11",
}
# What goes between the keywords of a query, and for blanks in the name of a city.
KEYWORD_SEPARATOR = {"INDEED": "+", "GLASSDOOR": "-", "MONSTER": "-"}
CITY_SEPARATOR = {"INDEED": "+", "GLASSDOOR": "-", "MONSTER": "-"}
# ---- End of fixed values ------------------------------------------------------------------


def _lookup(column: Column, table: dict) -> Column:
    """Value of a small fixed table, as a constant map inside the plan: no join, no shuffle."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column)


def _pair(df_provider: Column, df_locale: Column) -> Column:
    return F.concat_ws("/", df_provider, df_locale)


def searches_providers(searches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per search and provider with its ``collector``; and the pairs nobody collects."""
    known = {f"{p}/{loc}": f"{p.lower()}_{loc.lower()}" for p, locs in SUPPORTED.items() for loc in locs}
    each = searches.withColumn("provider", F.explode("providers"))
    each = each.withColumn("collector", _lookup(_pair(F.col("provider"), F.col("locale")), known))
    return (
        each.where(F.col("collector").isNotNull()),
        each.where(F.col("collector").isNull()).drop("collector"),
    )


def search_domain(searches: DataFrame) -> DataFrame:
    """The given domain or the usual one of the locale; ``domain_reason`` when there is neither."""
    domain = F.coalesce(
        F.when(F.col("domain") != "", F.col("domain")), _lookup(F.col("locale"), DOMAIN_BY_LOCALE)
    )
    unknown = F.concat(F.lit("Unknown domain for locale: "), F.coalesce("locale", F.lit("none")))
    return searches.withColumns({"domain": domain, "domain_reason": F.when(domain.isNull(), unknown)})


def search_defaults(searches: DataFrame) -> DataFrame:
    """Lower-case city; radius, listing age and remoteness where a search leaves them out.

    Only a missing value takes the default: a radius of zero stays zero.
    """
    return searches.withColumns(
        {
            "city": F.lower("city"),
            "radius": F.coalesce("radius", F.lit(DEFAULT_RADIUS)),
            "max_listing_days": F.coalesce("max_listing_days", F.lit(DEFAULT_MAX_LISTING_DAYS)),
            "remoteness": F.coalesce("remoteness", F.lit("ANY")),
        }
    )


def with_search_reason(searches: DataFrame) -> DataFrame:
    """Add ``reject_reason``, the first thing that makes a search unusable, or null."""
    def empty(name: str) -> Column:
        return F.coalesce(F.size(name), F.lit(0)) < 1

    def unset(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    return searches.withColumn(
        "reject_reason",
        F.when(F.col("province").isNull(), "Province/State not set")
        .when(unset("city"), "City not set")
        .when(unset("locale"), "Locale not set")
        .when(empty("providers"), "Providers not set")
        .when(empty("keywords"), "Keywords not set")
        .when(F.coalesce(F.col("max_listing_days") < 1, F.lit(False)), "Cannot set max posting days < 1")
        .when(unset("domain"), "Domain not set")
        .when(F.coalesce(F.col("remoteness") == "UNKNOWN", F.lit(False)), "Remoteness is UNKNOWN!"),
    )


def search_validate(searches: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = with_search_reason(searches)
    return (
        checked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        checked.where(F.col("reject_reason").isNotNull()),
    )


def query_text(searches: DataFrame) -> DataFrame:
    """``query`` to show, and ``query_part``, the keywords as the provider's address wants them."""
    joined = F.lit(None).cast("string")
    for provider, separator in KEYWORD_SEPARATOR.items():
        joined = F.when(F.col("provider") == provider, F.array_join("keywords", separator)).otherwise(joined)
    part = F.when(F.col("provider") == "MONSTER", F.replace(joined, F.lit(" "), F.lit("-"))).otherwise(joined)
    return searches.withColumns({"query": F.array_join("keywords", " "), "query_part": part})


def quantize_radius(searches: DataFrame) -> DataFrame:
    """``site_radius``: the largest radius of the provider that is not above the wanted one."""
    unit = F.when(F.col("locale").isin(*MILE_LOCALES), "mi").otherwise("km")
    steps = F.element_at(
        F.create_map(
            *[
                x
                for (provider, of_unit), values in RADIUS_STEPS.items()
                for x in (F.lit(f"{provider}/{of_unit}"), F.array(*[F.lit(v) for v in values]))
            ]
        ),
        F.concat_ws("/", "provider", unit),
    )
    wanted = F.greatest(F.col("radius"), F.lit(0))
    step = F.array_max(F.filter(steps, lambda s: s <= wanted))
    in_miles = _lookup(step, GLASSDOOR_KM_TO_MILES)
    converted = F.when((F.col("provider") == "GLASSDOOR") & (unit == "km"), in_miles).otherwise(step)
    return searches.withColumn("site_radius", converted)


def search_urls(searches: DataFrame) -> DataFrame:
    """Add ``search_url``, the first result page, and ``url_reason``. Needs ``provider`` and ``locale`` and checked searches.

    Where the provider wants a ``location_id`` that is not there, the address is null and ``url_reason``
    says so; it is null otherwise. ``{page}`` stays for ``frontier_pages``.
    """
    df = quantize_radius(query_text(searches))
    provider = F.col("provider")
    city = F.lower("city")
    place = F.col("location_id").cast("string") if "location_id" in df.columns else F.lit(None).cast("string")
    values = {
        "{domain}": F.col("domain"),
        "{query}": F.col("query_part"),
        "{city}": F.replace(city, F.lit(" "), _lookup(provider, CITY_SEPARATOR)),
        "{REGION}": F.upper("province"),
        "{region}": F.col("province"),
        "{radius}": F.col("site_radius").cast("string"),
        "{limit}": _lookup(provider, PAGE_SIZE).cast("string"),
        "{similar}": F.coalesce(F.col("similar").cast("int"), F.lit(0)).cast("string"),
        "{remote}": F.coalesce(_lookup(F.col("remoteness"), REMOTE_CODES), F.lit("")),
        "{location_id}": place,
    }
    url = _lookup(_pair(provider, F.col("locale")), {f"{p}/{loc}": t for (p, loc), t in URL_TEMPLATES.items()})
    reason = F.when(url.contains("{location_id}") & place.isNull(), "location id unset")
    for placeholder, value in values.items():
        url = F.replace(url, F.lit(placeholder), F.coalesce(value, F.lit("")))
    return df.withColumns({"search_url": F.when(reason.isNull(), url), "url_reason": reason})


def page_count(results: Column, page_size: Column) -> Column:
    return F.ceil(results / page_size).cast("int")


def frontier_pages(searches: DataFrame) -> DataFrame:
    """One row per result page: ``page_no`` from 1 and ``page_url``.

    Indeed counts rows, from 0. Monster puts a page number into the address from page 2 on.
    Glassdoor's later pages come from ``next_link``, the link of the first page, with the number in
    it replaced; without that link only the first page is known. Needs ``n_pages``.
    """
    provider = F.col("provider")
    pages = F.when(F.col("n_pages") >= 1, F.sequence(F.lit(1), F.col("n_pages"))).otherwise(
        F.array().cast("array<int>")
    )
    link = F.col("next_link") if "next_link" in searches.columns else F.lit(None).cast("string")
    each = searches.withColumn("page_no", F.explode(pages))
    page = F.col("page_no")
    number = page.cast("string")
    start = ((page - 1) * PAGE_SIZE["INDEED"]).cast("string")
    part = F.when(page > 1, F.concat(F.lit("page="), number, F.lit("&"))).otherwise("")
    later = F.concat(
        F.lit("https://www.glassdoor."),
        F.col("domain"),
        F.regexp_replace(link, F.lit(r"_IP\d+\."), F.concat(F.lit("_IP"), number, F.lit("."))),
    )
    url = (
        F.when(provider == "INDEED", F.concat("search_url", F.lit("&start="), start))
        .when(provider == "MONSTER", F.replace("search_url", F.lit("{page}"), part))
        .when(page == 1, F.col("search_url"))
        .otherwise(later)
    )
    return each.withColumn("page_url", url).where(F.col("page_url").isNotNull())


@dataclass(frozen=True)
class Pacing:
    """How long to wait before each request to a host, in seconds."""

    algorithm: str = "LINEAR"
    max_duration: float = 5.0
    min_duration: float = 1.0
    random: bool = False
    converge: bool = False
    seed: int = 0

    def __post_init__(self) -> None:
        if self.max_duration <= 0:
            raise ValueError("The longest delay must be above 0.")
        if self.min_duration <= 0 or self.min_duration >= self.max_duration:
            raise ValueError("The shortest delay must be above 0 and below the longest one.")
        if self.algorithm not in ("CONSTANT", "LINEAR", "SIGMOID"):
            raise ValueError(f"Unknown delay curve: {self.algorithm}")
        if self.converge and not self.random:
            raise ValueError("A converging delay must be random.")

    def curve(self, i: Column, n: Column) -> Column:
        """Delay before request ``i`` of ``n``, by the curve alone."""
        top = float(self.max_duration)
        flat = F.lit(top)
        if self.algorithm == "SIGMOID":
            growth, start = 4 * F.sqrt(flat), F.log(4 * flat)
            return flat / (1 + F.exp(-(i / growth - start)))
        if self.algorithm == "LINEAR" and 5 * top > 1:
            return F.when(i < ceil(5 * top), i / 5).otherwise(flat)
        # Almost constant: the first eight requests rise to the full delay.
        rising = F.least(n, F.lit(8))
        step, drop = (top / 8, rising * (top / 8)) if top < 1.5 else (0.2, rising / 5)
        return F.when(i < 8, (flat - drop) + i * F.lit(step)).otherwise(flat)

    def delay(self, i: Column, n: Column, *identity: Column) -> Column:
        value = F.greatest(self.curve(i, n), F.lit(float(self.min_duration)))
        if self.random:
            # A hash of the request stands for chance, so a task that runs again gives the same.
            chance = F.pmod(F.xxhash64(*identity, i, F.lit(self.seed)), F.lit(1 << 53)) / float(1 << 53)
            low, high = (
                (value, F.lit(float(self.max_duration)))
                if self.converge
                else (F.lit(float(self.min_duration)), value)
            )
            value = low + chance * (high - low)
        return F.when(i == 0, 0.0).otherwise(F.round(value, 3))


def pacing_offsets(requests: DataFrame, pacing: Pacing, host: str = "host", order: str = "ordinal") -> DataFrame:
    """Add ``position`` within the host, ``delay`` and ``offset``, the sum of the delays so far.

    ``order`` is a whole number of 0 or more, different for every request of a host. Positions and
    sums are built from short blocks, so no task ever orders all requests of one busy host.
    """
    # Written once: the sums below read it twice, and one of these reads takes two columns only.
    placed = staged(running_index(requests, host, order, "position", total="n_requests"), "positions")
    delayed = placed.withColumn("delay", pacing.delay(F.col("position"), F.col("n_requests"), F.col(host)))
    return running_total(delayed, host, order, "delay", "offset").drop("n_requests")
