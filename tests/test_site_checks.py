"""Checks over the DOM relation: planted markup against codes worked out by hand, urls against the standard library."""

import itertools
from urllib.parse import urljoin as plain_join

import pytest
from pyspark.sql import functions as F

from sitegauge.functions import urls
from sitegauge.operators import site_checks as checks
from sitegauge.sources.dom import clean_type, dom, ld_walk
from sitegauge.sources.evidence import evidence_pages

BASE = '<html><head><title>Corner Shop</title></head><body><nav><a href="/a">A</a></nav><article><h1>Head</h1><p>' + "word " * 90 + "</p></article><footer>end</footer></body></html>"


@pytest.fixture(scope="module")
def relation(spark):
    pages = spark.createDataFrame([(k, "https://shop.example/stories/", BASE) for k in range(8)] + [(8, None, None), (None, "u", BASE)], "page_id long, url string, html string")
    return dom(evidence_pages(pages)).cache()


def by_page(frame):
    return {r.page_id: r for r in frame.collect()}


def test_structure(relation):
    got = by_page(checks.html_structure(relation))
    assert {k: r.codes.split() for k, r in got.items()} == {
        0: ["no_description"], 1: [], 2: [],
        3: ["no_description", "fields_without_label", "form_script_action", "form_without_method", "fields_without_name", "fields_without_autocomplete", "form_without_named_submit", "no_plain_form", "images_without_alt", "controls_without_name"],
        4: ["no_description"], 5: ["long_description", "vague_links", "dead_links"], 6: ["no_description"], 7: ["fields_without_label"],
        8: ["no_h1", "few_landmarks", "no_title", "no_description"], None: ["no_description"],
    }
    assert [got[k].score for k in range(9)] == [3, 4, 4, 1, 3, 1, 3, 3, 1]
    assert [got[k].state for k in (0, 1, 3)] == ["partial", "pass", "fail"]


def test_crawl_efficiency(relation):
    got = by_page(checks.crawl_efficiency(relation))
    assert {k: r.codes.split() for k, r in got.items()} == {
        0: ["no_validator", "no_viewport"], 1: ["slow_response"], 2: ["slow_response", "no_validator", "no_viewport"],
        3: ["slow_response", "blocking_stylesheets", "unsized_media", "sync_scripts", "zoom_limited"], 4: ["slow_response", "no_validator", "no_viewport"], 5: ["no_viewport"],
        6: ["slow_response", "no_validator", "no_viewport"], 7: ["slow_response", "many_viewports", "viewport_width"], 8: ["slow_response", "no_validator", "no_viewport"], None: ["no_validator", "no_viewport"],
    }
    # response, validators, sheets, media, scripts, body, viewport
    assert [got[k].points for k in range(8)] == [4 + 0 + 16 + 0, 2 + 4 + 16 + 4, 2 + 2 + 16 + 0, 2 + 4 + 0 + 2 + 2 + 4 + 2, 0 + 0 + 16 + 0, 4 + 4 + 16 + 0, 2 + 2 + 16 + 0, 2 + 4 + 16 + 2]
    assert (got[3].stylesheets, got[3].unsized, got[3].scripts) == (4, 3, 3) and [got[k].score for k in (1, 3, 4)] == [3, 2, 2]
    assert [got[k].responsive for k in range(8)] == [False, False, False, True, False, False, True, False]


def test_indexing(relation):
    got = by_page(checks.indexing(relation))
    assert [got[k].score for k in range(8)] == [5, 5, 5, 0, 2, 4, 2, 3]
    assert got[3].blocking == "meta robots" and got[4].snippets == "meta googlebot" and got[5].standard == "meta robots" and got[6].nosnippets == 1
    assert got[7].restricting == "X-Robots-Tag googlebot; X-Robots-Tag" and got[3].restricting == got[7].restricting
    assert got[8].score == 5


def test_structured_data(relation):
    ld = checks.with_json_ld(relation)
    got = by_page(checks.structured_data(ld))
    assert [(got[k].score, got[k].state, got[k].codes) for k in range(8)] == [
        (0, "fail", "no_schema"), (0, "fail", "no_schema"), (5, "pass", ""), (0, "fail", "no_schema"), (4, "partial", "missing_fields"), (1, "fail", "invalid_json"), (3, "partial", "missing_fields"), (5, "pass", ""),
    ]
    assert got[4].missing == "recommended brand" and got[6].missing == "recommended dateModified, recommended image" and got[6].speakable and not got[2].speakable
    shop = by_page(checks.structured_data(ld, ecommerce=True))
    assert shop[4].missing == "recommended brand, recommended gtin, recommended aggregateRating|review, recommended offers.shippingDetails, recommended offers.hasMerchantReturnPolicy" and shop[4].score == 3


def test_entities(relation):
    got = by_page(checks.entity_coherence(checks.with_json_ld(relation)))
    assert (got[2].score, got[2].state, got[2].codes, got[2].platforms) == (2, "pass", "", "Instagram, YouTube, LinkedIn")
    assert got[2].positives.split() == ["og_title", "og_description", "og_url", "twitter_card", "social_image", "schema_image", "schema_name", "profiles_match"]
    assert got[0].codes.split() == ["no_og_title", "no_og_description", "no_og_url", "no_twitter_card", "no_social_image", "no_schema_image", "no_schema_name", "no_profiles"] and got[0].state == "warn"
    assert got[7].codes.split() == ["og_title_differs", "og_description_differs", "no_og_url", "twitter_title_differs", "no_schema_image", "schema_name_differs", "profiles_differ"] and got[7].score == 1


def test_canonical_link(relation):
    got = by_page(checks.canonical_link(relation))
    assert [got[k].kind for k in range(8)] == ["none", "self", "self", "none", "other_site", "none", "self", "none"]
    assert got[6].canonical == "https://shop.example/stories/?p=1"


def test_walk_is_bounded():
    deep = "x"
    for _ in range(100):
        deep = '{"@type": "Thing", "a": %s}' % (deep if deep != "x" else '"x"')
    got = ld_walk([deep])
    assert got["cut"] and sum(not o["top"] for o in got["objects"]) == 31
    many = ld_walk(["[" + ",".join('{"@type": "T%d"}' % k for k in range(40)) + "]"])
    assert len(many["schema_types"]) == 32 and many["ignored"] == 8 and many["cut"]
    assert ld_walk(["{}"] * 60)["ignored"] == 10 and ld_walk(["[" * 100000, "nope"])["invalid"] == 2
    assert [clean_type(t) for t in ("https://schema.org/Offer/", "Offer", "offer", "a/b", "x://y", None, "A" * 65)] == ["Offer", "Offer", None, None, None, None, None]


def test_urls(spark):
    bases = ["https://a.example/x/y?q=1#f", "http://a.example", "https://A.example:8080/x/"]
    refs = ["", "b", "./b", "../b/c", "../../../b", "/r/./s/../t", "//o.example/z", "?k=v", "#frag", "HTTP://o.example/A", "mailto:x@y", "b/..", "b/./", "c?x=/../y"]
    rows = spark.createDataFrame(list(itertools.product(bases, refs)), "base string, ref string")
    for r in rows.select("base", "ref", urls.urljoin(F.col("base"), F.col("ref")).alias("u")).collect():
        assert r.u == plain_join(r.base, r.ref), (r.base, r.ref)
    one = spark.createDataFrame([("https://www.A.example:443/x/?q#f", "http://a.example", "ftp://x", None)], "a string, b string, c string, d string")
    got = one.select(urls.page_url(F.col("a")), urls.plain_url(F.col("a")), urls.same_site(F.col("a"), F.col("b")), urls.page_url(F.col("c")), urls.plain_url(F.col("b")), urls.page_url(F.col("d"))).first()
    assert tuple(got) == ("https://www.a.example:443/x?q", "https://www.a.example/x", True, None, "http://a.example/", None)


def test_align(spark):
    cases = [("Corner Shop", "corner  shop", True), ("Corner Shop of Town", "Corner Shop", True), ("abc", "abcd", False), ("red chair sale", "big red chair", True), ("the and our", "the and our x", True), ("one", "two", False), (None, "x", False), ("", "", False)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    assert [r.x for r in rows.select(checks.texts_align(F.col("a"), F.col("b")).alias("x")).collect()] == [x for _, _, x in cases]
