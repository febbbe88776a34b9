"""Search checks, addresses and pacing."""

import math

import pytest
from pyspark.sql import functions as F

from roleledger.operators import crawl, running

SEARCH = """search_id bigint, keywords array<string>, province string, city string, locale string, domain string,
providers array<string>, radius int, max_listing_days int, similar boolean, remoteness string"""


def searches(spark, *rows):
    base = {
        "search_id": 1, "keywords": ["b33f", "d3ad"], "province": "TX", "city": "Austin", "locale": "USA_ENGLISH",
        "domain": None, "providers": ["INDEED"], "radius": 25, "max_listing_days": 60, "similar": False,
        "remoteness": "ANY",
    }
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], SEARCH)


@pytest.mark.parametrize("keywords, text", [(["b33f", "d3ad"], "b33f d3ad"), (["trumpet"], "trumpet")])
def test_query_text(spark, keywords, text):
    df = searches(spark, {"keywords": keywords}).withColumn("provider", F.lit("INDEED"))
    assert crawl.query_text(df).first()["query"] == text


@pytest.mark.parametrize(
    "locale, domain, expected",
    [
        ("CANADA_ENGLISH", None, "ca"), ("CANADA_FRENCH", None, "ca"), ("USA_ENGLISH", None, "com"),
        ("UK_ENGLISH", None, "co.uk"), ("FRANCE_FRENCH", None, "fr"), ("GERMANY_GERMAN", None, "de"),
        ("USA_ENGLISH", "xyz", "xyz"), ("ATLANTIS", "xyz", "xyz"),
    ],
)
def test_domain(spark, locale, domain, expected):
    row = crawl.search_domain(searches(spark, {"locale": locale, "domain": domain})).first()
    assert (row["domain"], row["domain_reason"]) == (expected, None)


def test_unknown_domain(spark):
    row = crawl.search_domain(searches(spark, {"locale": "ATLANTIS"})).first()
    assert row["domain_reason"] == "Unknown domain for locale: ATLANTIS"


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, None),
        ({"province": None}, "Province/State not set"),
        ({"city": None}, "City not set"),
        ({"locale": None}, "Locale not set"),
        ({"providers": []}, "Providers not set"),
        ({"providers": None}, "Providers not set"),
        ({"keywords": []}, "Keywords not set"),
        ({"max_listing_days": -1}, "Cannot set max posting days < 1"),
        ({"max_listing_days": 0}, "Cannot set max posting days < 1"),
        ({"domain": None}, "Domain not set"),
        ({"remoteness": "UNKNOWN"}, "Remoteness is UNKNOWN!"),
        ({"province": None, "city": None}, "Province/State not set"),
    ],
)
def test_validation(spark, change, reason):
    row = crawl.with_search_reason(searches(spark, {"domain": "com"} | change)).first()
    assert row["reject_reason"] == reason


def test_only_a_missing_value_takes_the_default(spark):
    rows = crawl.search_defaults(
        searches(spark, {"radius": 0, "max_listing_days": 0}, {"radius": None, "max_listing_days": None})
    ).collect()
    assert [(r["radius"], r["max_listing_days"]) for r in rows] == [(0, 0), (25, 60)]
    assert rows[0]["city"] == "austin"


def test_unsupported_pairs_are_set_aside(spark):
    df = searches(spark, {"locale": "CANADA_FRENCH"}, {"locale": "FRANCE_FRENCH", "providers": ["MONSTER", "GLASSDOOR"]})
    good, bad = crawl.searches_providers(df)
    assert [r["provider"] for r in good.collect()] == ["MONSTER"]
    assert sorted(r["provider"] for r in bad.collect()) == ["GLASSDOOR", "INDEED"]


@pytest.mark.parametrize(
    "provider, locale, radius, expected",
    [
        ("INDEED", "USA_ENGLISH", 4, 0), ("INDEED", "USA_ENGLISH", 24, 15), ("INDEED", "UK_ENGLISH", 1000, 100),
        ("MONSTER", "UK_ENGLISH", 19, 10), ("MONSTER", "USA_ENGLISH", 149, 100), ("MONSTER", "USA_ENGLISH", 75, 75),
        ("GLASSDOOR", "UK_ENGLISH", 9, 0), ("GLASSDOOR", "UK_ENGLISH", 30, 19), ("GLASSDOOR", "UK_ENGLISH", 250, 124),
        ("GLASSDOOR", "USA_ENGLISH", 16, 15), ("GLASSDOOR", "USA_ENGLISH", 0, 0),
    ],
)
def test_radius(spark, provider, locale, radius, expected):
    df = searches(spark, {"locale": locale, "radius": radius}).withColumn("provider", F.lit(provider))
    assert crawl.quantize_radius(df).first()["site_radius"] == expected


def test_no_address_without_a_place(spark):
    df = searches(spark, {"locale": "USA_ENGLISH"}).withColumn("domain", F.lit("com"))
    for provider, reason in (("GLASSDOOR", "location id unset"), ("INDEED", None)):
        row = crawl.search_urls(df.withColumn("provider", F.lit(provider)).withColumn("location_id", F.lit(None).cast("long"))).first()
        assert row["url_reason"] == reason and (row["search_url"] is None) == (reason is not None)


def test_pages(spark):
    df = spark.createDataFrame(
        [("INDEED", "i", 3, None), ("MONSTER", "m?{page}q", 2, None), ("GLASSDOOR", "g", 3, "/x_IP2.htm"),
         ("GLASSDOOR", "h", 3, None), ("INDEED", "none", 0, None)],
        "provider string, search_url string, n_pages int, next_link string",
    ).withColumn("domain", F.lit("com"))
    assert [r["page_url"] for r in crawl.frontier_pages(df).collect()] == [
        "i&start=0", "i&start=20", "i&start=40", "m?q", "m?page=2&q", "g", "https://www.glassdoor.com/x_IP2.htm",
        "https://www.glassdoor.com/x_IP3.htm", "h",
    ]


@pytest.mark.parametrize("algorithm", ["LINEAR", "CONSTANT", "SIGMOID", None])
@pytest.mark.parametrize("random, converge", [(True, True), (True, False), (False, True)])
@pytest.mark.parametrize("longest, shortest", [(1, 1), (-1, 1), (5, 0), (5, 1)])
def test_pacing_settings(algorithm, random, converge, longest, shortest):
    def make():
        return crawl.Pacing(algorithm, longest, shortest, random, converge)

    good = algorithm is not None and (random or not converge) and (longest, shortest) == (5, 1)
    if good:
        make()
    else:
        with pytest.raises(ValueError):
            make()


def delays(spark, pacing, n):
    df = spark.range(n).select(F.lit("h").alias("host"), F.col("id").alias("ordinal"))
    return [r["delay"] for r in crawl.pacing_offsets(df, pacing).orderBy("ordinal").collect()]


@pytest.mark.parametrize("top, low, n", [(5.0, 1.0, 40), (1.0, 0.3, 12), (0.2, 0.05, 5), (8.0, 2.0, 1)])
def test_pacing_curves(spark, top, low, n):
    constant = [top] * n
    rise = len(constant[:8])
    step, drop = (top / 8, rise * top / 8) if top < 1.5 else (0.2, rise / 5)
    constant[:8] = [top - drop + i * step for i in range(rise)]
    linear = [i / 5 if i < math.ceil(5 * top) else top for i in range(n)] if 5 * top > 1 else constant
    sigmoid = [top / (1 + math.exp(-(i / (4 * math.sqrt(top)) - math.log(4 * top)))) for i in range(n)]
    for name, curve in (("CONSTANT", constant), ("LINEAR", linear), ("SIGMOID", sigmoid)):
        expected = [0.0] + [max(v, low) for v in curve[1:]]
        assert delays(spark, crawl.Pacing(name, top, low), n) == pytest.approx(expected, abs=6e-4)


def test_no_requests(spark):
    assert delays(spark, crawl.Pacing(), 0) == []


def test_random_delays_stay_between_their_bounds_and_repeat(spark):
    plain = delays(spark, crawl.Pacing(), 50)
    low = delays(spark, crawl.Pacing(random=True, seed=3), 50)
    high = delays(spark, crawl.Pacing(random=True, converge=True, seed=3), 50)
    assert all(1.0 <= v <= p for v, p in zip(low[1:], plain[1:], strict=True))
    assert all(p <= v <= 5.0 for v, p in zip(high[1:], plain[1:], strict=True))
    assert len(set(high)) > 20 and high == delays(spark, crawl.Pacing(random=True, converge=True, seed=3), 50)


def test_running_totals_over_small_blocks(spark):
    """Three levels of blocks, two groups, gaps in the order."""
    df = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g"), (F.col("id") * 7).alias("o"), F.col("id").alias("v")
    )
    placed = running.running_index(df, "g", "o", "place", size=5, total="n")
    summed = running.running_total(placed, "g", "o", "v", "total", size=5)
    for group in "xy":
        rows = summed.where(F.col("g") == group).orderBy("o").collect()
        assert [r["place"] for r in rows] == list(range(len(rows)))
        assert {r["n"] for r in rows} == {len(rows)}
        so_far = 0
        for r in rows:
            so_far += r["v"]
            assert r["total"] == so_far
