"""Search and extraction operators over planted pages, against values worked out by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sitegauge.functions.urls import tokens
from sitegauge.operators import site_checks as checks
from sitegauge.operators import site_search as search
from sitegauge.sources.dom import dom
from sitegauge.sources.evidence import evidence_pages

BASE = '<html><head><title>Corner Shop</title></head><body><nav><a href="/a">A</a></nav><article><h1>Head</h1><p>' + "word " * 90 + "</p></article><footer>end</footer></body></html>"
URLS = ["https://shop.example/stories/"] * 6 + ["https://b.example/stories/"] * 2


@pytest.fixture(scope="module")
def relation(spark):
    pages = spark.createDataFrame([(k, u, BASE) for k, u in enumerate(URLS)] + [(8, None, None)], "page_id long, url string, html string")
    return checks.with_json_ld(dom(evidence_pages(pages))).cache()


def by(frame, key):
    return {r[key]: r for r in frame.collect()}


def test_blurbs(relation):
    got = by(search.blurb_issues(relation), "host")
    a, b = got["shop.example"], got["b.example"]
    assert (a.pages, a.no_title, a.no_description, a.no_h1, a.no_main, a.no_canonical) == (6, 0, 3, 0, 0, 3)
    assert (a.short, a.long, a.same_description, a.same_title, a.off_host, a.not_self, a.collisions) == (0, 1, 2, 6, 1, 0, 0)
    assert (b.no_description, b.no_canonical, b.not_self, b.social_differs, b.low_overlap) == (1, 1, 0, 1, 0)


def test_placeholder_and_year(spark):
    texts = ["Lorem ipsum dolor", "Description goes here", "Insert your description", "Welcome to our website!", "We say: welcome to our website!", "All rights reserved", "privacy policy and\nterms of use", "A shop", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(search.placeholder(F.col("t")).alias("x")).collect()] == [True, True, True, True, False, True, True, False, False]
    one = spark.createDataFrame([("In 1999 and 2031, not 12024 or 2099x",)], "t string").select(search._year(F.col("t")), search.normal(F.lit("Well-known O'Brien's, yes")), tokens(F.lit("The well-known O'Brien at a shop"), search.WORD, 2, search.STOPWORDS)).first()
    assert one[0] == 2031 and one[1] == "well known o brien s yes" and one[2] == ["well-known", "o'brien", "shop"]


def test_sampled_metadata(relation):
    got = by(search.sampled_metadata(relation), "host")
    a, b = got["shop.example"], got["b.example"]
    # pages 3 and 7 have a header as well
    assert (a.pages, a.no_title, a.no_canonical, a.off_site, a.no_schema, a.bad_schema, a.blocked, a.told, a.thin, a.ok) == (6, 0, 3, 1, 4, 1, 1, 3, 0, False)
    assert (b.no_schema, b.bad_schema, b.blocked, b.told, b.codes) == (0, 0, 0, 1, "no_canonical")


def test_trust_and_languages(relation, spark):
    got = by(search.trust_pages(relation), "host")
    assert (got["shop.example"].found, got["shop.example"].missing_core, got["shop.example"].ok) == ("returns", "about contact privacy", False)
    assert (got["b.example"].found, got["b.example"].missing_more, got["b.example"].missing_shop, got["b.example"].ok) == ("about contact privacy", "terms support", "returns shipping", True)
    links = '<link rel="alternate" hreflang="en" href="https://c.example/"><link rel="alternate" hreflang="DE" href="/de/"><link rel="alternate" hreflang="de" href=""><link rel="alternate" hreflang="english!" href="https://c.example/x">'
    page = dom(spark.createDataFrame([("https://c.example/", f"<head>{links}</head>"), ("https://c.example/de", links[:0] + '<link rel="alternate" hreflang="en" href="https://c.example/">')], "url string, html string"))
    r = search.hreflang_sets(page).first()
    assert (r.pages, r.invalid, r.no_href, r.relative, r.twice, r.no_self, r.no_default) == (2, 1, 1, 1, 1, 1, 1)


def test_freshness(relation):
    got = by(search.freshness(relation), "page_id")
    assert (got[6].section, got[6].dated, got[6].feeds, got[6].available) == (True, True, "https://b.example/feed.xml", True) and not got[0].available
    text = by(search.text_alternate(relation), "page_id")
    assert text[0].text_url == "https://shop.example/stories/index.md" and not text[0].linked


def test_discovery_score(spark):
    names = "crawlers_allowed sitemap_valid lastmod_good freshness sitemap_clean metadata_ok blurbs_ok hreflang_ok trust_ok".split()
    rows = [(1, *[True] * 9), (2, *[True] * 8, False), (3, *[False] * 7, True, True), (4, True, False, True, True, True, True, True, True, True), (5, True, True, False, False, True, True, False, True, True)]
    got = by(search.discovery_score(spark.createDataFrame(rows, ", ".join(["site_id long", *(f"{n} boolean" for n in names)]))), "site_id")
    assert [(got[k].score, got[k].state) for k in range(1, 6)] == [(4, "pass"), (3, "partial"), (0, "warn"), (2, "partial"), (2, "partial")]


def test_prices(spark):
    cases = {"$1,299.00": 1299, "1.299,00 EUR": 1299, "12,50": 12.5, "1.299": 1299, "1.299.50": 1299.5, "1.299.500": 1299500, "free": None, "99.9": 99.9, "EUR 19,90": 19.9}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", search.price_value(F.col("t")).cast("double").alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases


def test_extraction(relation):
    got = by(search.extraction_readiness(relation), "page_id")
    assert got[0].codes == "no_schema" and got[2].codes == "" and got[5].codes == "bad_schema" and got[5].caveats == "hidden_nodes"
    assert got[5].hidden_nodes == 2 and got[5].words == 1 + 1 + 90 + 12 + 1 and got[5].rendering == "readable"
    assert got[6].schema_types == "Article Person Thing" and got[8].codes.split()[:2] == ["no_text", "boilerplate"] and got[8].rendering == "blocked_or_empty"
    shop = by(search.extraction_readiness(relation, ecommerce=True), "page_id")
    assert shop[4].schema_missing == "brand gtin aggregateRating|review offers.shippingDetails offers.hasMerchantReturnPolicy"
    assert shop[4].visible_missing == "image shipping_details" and shop[4].mismatches == "image return_details"
    assert shop[0].schema_missing == "Product" and shop[0].mismatches == "product_name"
    assert "variants" in shop[7].mismatches.split()


def test_shares_round_as_sql_does(spark):
    """41 of 640 words: half a millionth, that a million times the share is just below."""
    html = "<html><body><nav>" + "w " * 41 + "</nav><main>" + "w " * 599 + "</main></body></html>"
    d = dom(spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string"))
    got = search.extraction_readiness(checks.with_json_ld(d)).collect()[0]
    assert (got.words, got.main_words, got.boilerplate) == (640, 599, duckdb.sql("select round((640 - 599) / 640, 6)").fetchall()[0][0]) and got.boilerplate == 0.064062


def test_product_facts_are_read_to_the_end(spark):
    """Facts after a million characters of text count as those at its beginning, and long names are compared whole."""
    facts = "In stock, $12.50 SKU: AB-123 refunds and delivery"
    name = "N" * 150 + " " + "M" * 150
    ld = '<script type="application/ld+json">{"@type": "Product", "name": "%s", "sku": "AB-123", "offers": {"price": "12.50", "availability": "InStock"}}</script>'
    pages = [
        (1, "<h1>A</h1>" + facts), (2, "<h1>A</h1>" + "word " * 200_000 + facts), (3, ld % name + f"<h1>{name}</h1>" + facts), (4, ld % (name + "X") + f"<h1>{name}</h1>" + facts),
        (5, "<h1>A</h1>" + "word " * 200_000 + "$1" + ",111" * 100_000),
    ]
    d = checks.with_json_ld(dom(spark.createDataFrame([(k, "https://a.example/", h) for k, h in pages], "page_id long, url string, html string")))
    got = by(search.extraction_readiness(d, ecommerce=True), "page_id")
    assert got[1].visible_missing == got[2].visible_missing == "image" and got[1].mismatches == got[2].mismatches == "product_name price availability sku_or_gtin return_details shipping_details"
    assert got[3].mismatches == "return_details shipping_details" and got[4].mismatches == "product_name return_details shipping_details"
    assert got[5].visible_missing == "availability sku_or_gtin image return_details shipping_details"
    assert by(search._visible_commerce(d), "page_id")[5].seen.price == "1" + ",111" * 100_000
