"""Extraction from hand-written pages."""

import datetime as dt
import json
import random
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from roleledger.functions import html
from roleledger.operators import extract, filters, normalize, registry
from roleledger.plans.collect import collect

PAGE = """<html><script>var x = "mosaic-provider-jobcards";</script>
<script id="mosaic-data" type="text/javascript">
window.mosaic.providerData["a"]={"n": 1};
window.mosaic.providerData["mosaic-provider-jobcards"]=%s;
window.other={};
</script></html>"""
CARDS = """{"metaData": {"mosaicProviderJobCardsModel": {"results": [
 {"displayTitle": "Engineer", "snippet": "<ul><li>does }; things</li></ul>", "company": "Co", "formattedLocation": "Here",
  "jobkey": "k1", "formattedRelativeTime": "3 days ago", "remoteLocation": true,
  "taxonomyAttributes": [{"label": "job-types", "attributes": [{"label": "Full-time"}, {"label": "Contract"}]},
    {"label": "EMPTY", "attributes": []}, {"label": "remote", "attributes": [{"label": "Hybrid work"}]}],
  "extractedSalary": {"min": 20, "max": 30.5, "type": "hourly"}},
 {"displayTitle": "Clerk", "jobkey": "k2", "extractedSalary": {"min": 0, "max": 30, "type": "hourly"}}]}}}"""


def pages(spark, *texts):
    return spark.createDataFrame(
        [(i, f"https://x/{i}", t) for i, t in enumerate(texts)], "page_id int, url string, html string"
    )


def test_embedded_json(spark):
    rows = extract.json_fields(extract.embedded_json_rows(pages(spark, PAGE % CARDS))).orderBy("pos").collect()
    first, second = rows
    assert first["title"] == "Engineer" and first["description"] == "does }; things"
    assert first["tags"] == ["Job types: Full-time, Contract", "Remote: Hybrid work"]
    assert first["wage"] == "$20 - $30.5 hourly" and first["remoteness"] == "FULLY_REMOTE"
    assert second["wage"] == "" and second["company"] is None and second["tags"] == []
    assert second["remoteness"] == "UNKNOWN"


def test_pages_without_good_json_are_set_aside(spark):
    broken = pages(
        spark, PAGE % CARDS, "<html></html>", PAGE.replace("mosaic-provider-jobcards\"]", "b\"]") % CARDS,
        PAGE % CARDS[:-30], PAGE % '{"metaData": {}}', PAGE % "{}", None,
    )
    reasons = {r["page_id"]: r["reject_reason"] for r in extract.embedded_json(broken).collect()}
    assert reasons == {0: None, 1: "no script", 2: "no job cards", 3: "bad JSON", 4: "no results", 5: "no results", 6: "no script"}
    assert {r["page_id"] for r in extract.embedded_json_rows(broken).collect()} == {0}
    cut = pages(spark, PAGE % CARDS.replace('"Clerk"', '"Clerk'))
    assert extract.embedded_json(cut).first()["reject_reason"] == "bad JSON"
    assert extract.embedded_json_rows(cut).count() == 0


def test_remoteness_from_tags(spark):
    df = spark.createDataFrame(
        [(["Pay: $1", "Remote: Remote "], "UNKNOWN"), (["Work remotely: Hybrid work", "Remote: Remote"], "UNKNOWN"),
         (["remote"], "IN_PERSON"), (["Remote: No"], "IN_PERSON"), (["Pay"], "IN_PERSON"), ([], "UNKNOWN")],
        "tags array<string>, remoteness string",
    )
    assert [r["remoteness"] for r in extract.remoteness_from_tags(df).collect()] == [
        "FULLY_REMOTE", "TEMPORARILY_REMOTE", "FULLY_REMOTE", "UNKNOWN", "IN_PERSON", "UNKNOWN",
    ]


@pytest.mark.parametrize(
    "now, phrase, expected",
    [
        ("2024-01-31 10:30", "7 hours ago", "2024-01-31"),
        ("2024-01-31 10:30", "11 hr", "2024-01-30"),
        ("2024-01-31 10:30", "30+ days ago", "2024-01-01"),
        ("2024-01-31 10:30", "5d", "2024-01-26"),
        ("2024-03-31 10:30", "1 month ago", "2024-02-29"),
        ("2024-02-29 10:30", "1 year ago", "2023-02-28"),
        ("2024-01-31 10:30", "il y a 2 mois", "2023-11-30"),
        ("2024-01-31 10:30", "il y a 2 jours", "2024-01-29"),
        ("2024-01-31 10:30", "1 annee", "2023-01-31"),
        ("2024-01-31 10:30", "Yesterday", "2024-01-30"),
        ("2024-01-31 10:30", "just posted", "2024-01-31"),
        ("2024-01-31 10:30", "2 days 3 hours ago", "2024-01-31"),
        ("2024-01-31 10:30", "soon", None),
        ("2024-01-31 10:30", "vor 3 Tagen", None),
        ("2024-01-31 10:30", None, None),
    ],
)
def test_relative_dates(spark, now, phrase, expected):
    as_of = dt.datetime.fromisoformat(now)
    df = spark.createDataFrame([(phrase,)], "age_text string")
    row = extract.with_post_date(df, as_of).first()
    assert row["post_date_inferred"] == (expected is None)
    assert row["post_date"] == (dt.date.fromisoformat(expected) if expected else as_of.date())


def test_german_dates_when_asked_for(spark):
    df = spark.createDataFrame([("vor 3 Tagen",), ("vor 2 Monaten",)], "age_text string")
    rows = extract.with_post_date(df, dt.datetime(2024, 1, 31), german=True).collect()
    assert [r["post_date"] for r in rows] == [dt.date(2024, 1, 28), dt.date(2023, 11, 30)]


def test_text_of_a_nested_element(spark):
    page = '<div id="a">no</div><div class="x" id="b"> one <div>two<br>three &amp; <b>four</b></div> five </div><div>six</div>'
    df = pages(spark, page, "<p>none</p>", None, '<div id="b">never closed')
    texts = [r["t"] for r in html.with_text_by_id(df, "html", "b", "t").orderBy("page_id").collect()]
    assert texts == ["one twothree & four five", None, None, "never closed"]


def test_nested_listings(spark):
    page = '<div class="page"><div class="a flex-row b"><div>x</div></div>\n<div class="flex-row"><div class="flex-rows">y</div></div></div>'
    rows = extract.split_listings(pages(spark, page), "div", "flex-row").collect()
    assert [(">x<" in r["fragment"], ">y<" in r["fragment"]) for r in rows] == [(True, False), (False, True)]


@pytest.mark.parametrize(
    "locale, text, hits",
    [
        ("USA_ENGLISH", "1,234 jobs", 1234), ("USA_ENGLISH", "25+ jobs in Austin", 25), ("USA_ENGLISH", "no jobs", 0),
        ("USA_ENGLISH", None, 0), ("FRANCE_FRENCH", "Page 1 de 1,234 emplois", 1234),
        ("GERMANY_GERMAN", "Seite 1 von 1.234 Jobs", 1234), ("GERMANY_GERMAN", "Seite 1", 0),
    ],
)
def test_result_count(spark, locale, text, hits):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(extract.result_count(F.col("t"), locale)).first()[0] == hits


def test_page_count(spark):
    df = spark.createDataFrame([("230 jobs",), ("20 jobs",), ("0 jobs",)], "t string")
    rows = extract.result_page_count(df, "t", "INDEED", "USA_ENGLISH").collect()
    assert [r["n_pages"] for r in rows] == [12, 1, 0]


def test_quotes_and_scripts(spark):
    page = """<a class=x href='/one?a=1'>A</a><div id="d">Text<script>var x = 1;</script><style>p {}</style> ends</div>"""
    df = spark.createDataFrame([(page,), ("<a href=/two>",), ('<a href="/three">',)], "h string")
    assert [r[0] for r in df.select(html.attribute(F.col("h"), "href")).collect()] == ["/one?a=1", "/two", "/three"]
    assert [r["t"] for r in html.with_text_by_id(df, "h", "d", "t").collect()] == ["Text ends", None, None]


class Elements(HTMLParser):
    """The elements of one tag with a class, as the standard library's parser meets them: an independent count."""

    def __init__(self, page, tag, css_class):
        super().__init__(convert_charrefs=False)
        self.page, self.tag, self.css_class, self.open, self.found = page, tag, css_class, [], []
        self.starts = [0]
        for line in page.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.feed(page)
        self.found += [(at, len(page)) for at, wanted in self.open if wanted]

    def place(self):
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag == self.tag:
            self.open.append((self.place(), self.css_class in (dict(attrs).get("class") or "").split()))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag == self.tag and self.open:
            at, wanted = self.open.pop()
            if wanted:
                self.found.append((at, self.page.index(">", self.place()) + 1))

    def fragments(self):
        return [self.page[a:b] for a, b in sorted(self.found)]


def test_elements_against_another_parser(spark):
    pick = random.Random(8)
    bits = [
        "<li>", "<li class='jl x'>", '<li class="a jl">', "<li class=jl>", "<LI CLASS='jl'>", "</li>", "</li>", "</li >", "<lid>", "<ul>", "</ul>",
        "text ", "a > b ", '<li class="jlx">', "<!-- <li class='jl'> -->", "<script>'</li>'</script>", '<a title="</li>">', "<li/>", "\n", "<p class=jl>",
    ]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randrange(60))) for _ in range(150)]
    found = {}
    for r in extract.split_listings(pages(spark, *texts), "li", "jl").collect():
        found.setdefault(r["page_id"], []).append((r["pos"], r["fragment"]))
    for i, text in enumerate(texts):
        assert [f for _, f in sorted(found.get(i, []))] == Elements(text, "li", "jl").fragments()


def test_blocks_in_blocks_and_the_last_block(spark):
    page = '<div class="page"><div class="flex-row"><div>x<div>deep</div></div></div><div class="flex-row">y<div>z</div></div><p>footer</p></div>'
    rows = extract.split_listings(pages(spark, page), "div", "flex-row").collect()
    assert [r["fragment"] for r in rows] == ['<div class="flex-row"><div>x<div>deep</div></div></div>', '<div class="flex-row">y<div>z</div></div>']
    listing = '<ul><li class="jl" data-id="1"><ul><li>perk</li></ul><div class="jobEmpolyerName">Co</div></li></ul>'
    (row,) = extract.split_listings(pages(spark, listing), *extract.LISTING_BLOCK["GLASSDOOR"]).collect()
    assert "Co</div></li>" in row["fragment"]


def test_character_references(spark):
    pick = random.Random(4)
    names = sorted(html5)
    texts = ["Caf&eacute; &#8217;s &amp;lt; &notit; &copy 2020 &bogus; & alone", None, "plain", "&#0;&#128;&#xD800;&#1114112;&#65535;&#13;&#x0041;"]
    for _ in range(200):
        bits = [
            "&" + pick.choice(names), "&" + pick.choice(names).rstrip(";") + pick.choice(["", "x", ";"]), f"&#{pick.randrange(1 << pick.randrange(1, 22))};",
            f"&#x{pick.randrange(1 << 21):x}", "&", "#", ";", " ", "word", "&#", f"&#{'9' * pick.randrange(1, 30)};", "&amp;",
        ]
        texts.append("".join(pick.choice(bits) for _ in range(12)))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", html.unescaped(F.col("t")).alias("u")).collect():
        assert r["u"] == (None if r["t"] is None else unescape(r["t"]))


def test_detail_pages_are_read_without_python(spark):
    detail = '<div id="jobDescriptionText">Caf&eacute;<div> &#8217;s</div></div>'
    landed = spark.createDataFrame([("u1", detail), ("u2", None), ("other", detail), (None, detail)], "url string, html string")
    rows = spark.createDataFrame([("u1", "none"), ("u2", "kept"), ("u3", "kept"), (None, "kept")], "url string, description string")
    for most in (extract.MAX_BROADCAST_URLS, 0):
        extract.MAX_BROADCAST_URLS, before = most, extract.MAX_BROADCAST_URLS
        try:
            done = extract.attach_detail(rows, landed, "jobDescriptionText")
        finally:
            extract.MAX_BROADCAST_URLS = before
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "InArrow" not in plan and ("LeftSemi" in plan) == (most > 0)
        assert {r["url"]: r["description"] for r in done.collect()} == {"u1": "Café ’s", "u2": "kept", "u3": "kept", None: "kept"}


def test_a_site_added_by_a_user(spark):
    def site(df):
        return extract.page_fields(df).select(
            F.col("page_id").cast("string").alias("key_id"), "title", F.lit("Co").alias("company"),
            F.lit("Here").alias("location"), "url",
        )

    registry.register_extractor("MINE", "UK_ENGLISH", site)
    with pytest.raises(ValueError):
        registry.register_extractor("MINE", "UK_ENGLISH", site)
    with pytest.raises(ValueError):
        registry.extractor_for("MINE", "USA_ENGLISH")
    good, bad = registry.extract(pages(spark, "<title>T</title>", "<p>"), "MINE", "UK_ENGLISH")
    assert [r["title"] for r in good.collect()] == ["T"]
    assert [r["missing_field"] for r in bad.collect()] == ["title"]
    registry.register_extractor("MINE", "UK_ENGLISH", lambda df: df.select("url"), replace=True)
    with pytest.raises(ValueError):
        registry.extract(pages(spark, "x"), "MINE", "UK_ENGLISH")


def test_missing_values_reject_nothing(spark):
    df = spark.createDataFrame(
        [(None, None, None, None, None)], "key_id string, status string, company string, post_date date, remoteness string"
    )
    lists = df.select("key_id").limit(0)
    kept = filters.filter_postings(
        df, as_of=dt.date(2024, 1, 1), max_days=1, companies=["x"], block_list=lists, wanted_remoteness="IN_PERSON"
    )
    assert kept.count() == 1


def test_printable(spark):
    df = spark.createDataFrame([("aé​b\tc\n",)], "title string")
    assert normalize.clean_strings(df).first()["title"] == "ab\tc\n"


def landed(spark, *rows):
    return spark.createDataFrame(rows, "provider string, locale string, query string, page_no int, html string")


def test_the_sites_that_are_known():
    pairs = {(site, locale) for site, locales in registry.SITE_LOCALES.items() for locale in locales}
    assert len(pairs) == 12
    for pair in pairs:
        assert registry.extractor_for(*pair) in (registry.indeed, registry.glassdoor, registry.monster)
    assert len(registry.by_extractor(sorted(pairs))) == 3


def test_collection_in_one_plan(spark):
    block = '<div class="flex-row"><h2 class="title"><a data-bypass="true" data-m_impr_j_postingid="{0}" href="http://m/{0}">{1}</a></h2><div class="company">Co</div><div class="location">Here</div><time>2 days ago</time></div>'
    pages_of = landed(
        spark,
        ("INDEED", "UK_ENGLISH", "q", 1, PAGE % CARDS),
        ("INDEED", "FRANCE_FRENCH", "q", 1, "<html>blocked</html>"),
        ("MONSTER", "UK_ENGLISH", "q", 1, block.format("m1", "First") + block.format("m2", "Two")),
        ("MONSTER", "UK_ENGLISH", "q", 2, block.format("m1", "Again") + block.format("m3", "")),
        ("GLASSDOOR", "GERMANY_GERMAN", "q", 1, "<li class=jl></li>"),
    )
    own = '<div id="JobDescription">A whole text</div><section class="summary-section"><dt> Industries</dt><dd>IT</dd></section>'
    details = spark.createDataFrame([("http://m/m1", own), ("http://m/m2", '<div id="JobDescription">abc</div>')], "url string, html string")
    sites = [(s, locale) for s, locales in registry.SITE_LOCALES.items() for locale in locales]
    done = collect(pages_of, dt.datetime(2024, 1, 31), details, sites=sites)
    rows = {r["key_id"]: r for r in done.postings.collect()}
    assert sorted(rows) == ["INDEED_k1", "MONSTER_m1"]
    assert (rows["MONSTER_m1"]["title"], rows["MONSTER_m1"]["description"], rows["MONSTER_m1"]["tags"]) == ("Again", "A whole text", ["IT"])
    assert rows["MONSTER_m1"]["post_date"] == dt.date(2024, 1, 29) and rows["INDEED_k1"]["url"] == "https://www.indeed.co.uk/m/viewjob?jk=k1"
    reasons = {(r["provider"], r["reason"]) for r in done.rejected.collect()}
    assert reasons == {("INDEED", "no company"), ("MONSTER", "no title"), ("MONSTER", "description too short")}
    assert {(r["provider"], r["locale"], r["reject_reason"]) for r in done.pages.collect()} == {
        ("INDEED", "FRANCE_FRENCH", "no script"), ("GLASSDOOR", "GERMANY_GERMAN", "no extractor"),
    }


def test_a_key_that_two_providers_claim_stops_the_collection(spark):
    def site(provider, prefix):
        def extractor(df):
            empty = [F.lit("x").alias(c) for c in ("title", "company", "location", "url")]
            return df.select("locale", "query", "page_no", F.lit(provider).alias("provider"), F.lit(prefix).alias("key_id"), F.lit("today").alias("age_text"), *empty)

        return extractor

    # One provider's name and key make the other's prefixed key.
    registry.register_extractor("A", "UK_ENGLISH", site("A", "B_1"), replace=True)
    registry.register_extractor("A_B", "UK_ENGLISH", site("A_B", "1"), replace=True)
    both = landed(spark, ("A", "UK_ENGLISH", "q", 1, ""), ("A_B", "UK_ENGLISH", "q", 1, ""))
    with pytest.raises(ValueError, match="two providers"):
        collect(both, dt.datetime(2024, 1, 31), sites=[("A", "UK_ENGLISH"), ("A_B", "UK_ENGLISH")])


def test_names_of_references_are_found_without_a_search():
    """A lookup goes through a handful of names at most."""
    buckets = json.loads(html._names())
    assert sum(map(len, buckets)) > 2000 and max(map(len, buckets)) < 10
