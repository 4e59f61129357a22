"""The audit over recorded responses: thirteen rows a site, and faults that stay with their site and check."""

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import site_report as report
from sitegauge.sources import fetches
from sitegauge.sources.dom import dom
from sitegauge.sources.fixtures import relation

GOOD = "<html><head><title>Shop of lamps</title></head><body><h1>Lamps</h1><p>" + "word " * 90 + "</p></body></html>"
POISON = GOOD.replace("<h1>", "<![x[<h1>")  # refused by the parser


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"https://h{k % 3}.example/{k}", GOOD) for k in range(12)] + [(None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def evidence(spark, pages):
    sites = fetches.sites(pages).select("site_id", "root")
    fixed = {n: relation(spark, n) for n in ("crawler", "purpose", "access", "entity", "surface_kind")}
    scope = sites.select("site_id", F.lit(True).alias("protocols"), F.lit(False).alias("account_auth"), F.lit(False).alias("commerce"))
    return report.Evidence(sites, fetches.responses(spark, pages), fixed | {"scope": scope, "hint": relation(spark, "hint")}, "2024-06-01")


def by_check(frame):
    return {(r.site_id, r.check_name): (r.score, r.state, r.evidence) for r in frame.collect()}


def test_a_poisoned_site_changes_its_own_rows_only(spark, pages):
    rubric = relation(spark, "rubric")
    clean = by_check(report.audit_rows(evidence(spark, pages), rubric))
    assert len(clean) == 12 * 13 and {c for _, c in clean} == set(report.REGISTRY) == {r.check_name for r in rubric.collect()}
    # one site's homepage is refused by the parser; its own page is of another host than all others, so no host is told of it
    odd = pages.withColumn("html", F.when(F.col("page_id") == 7, POISON).otherwise(F.col("html"))).withColumn("url", F.when(F.col("page_id") == 7, "https://alone.example/").otherwise(F.col("url")))
    alone = by_check(report.audit_rows(evidence(spark, pages.withColumn("url", F.when(F.col("page_id") == 7, "https://alone.example/").otherwise(F.col("url")))), rubric))
    poisoned = by_check(report.audit_rows(evidence(spark, odd), rubric))
    changed = {k for k in alone if alone[k] != poisoned[k]}
    on_page = {"html_structure", "schema_ld", "ssr", "pagespeed", "canonical", "indexing", "social"}
    assert {s for s, _ in changed} == {7} and on_page - {"search_discovery"} <= {c for _, c in changed} <= on_page | {"search_discovery"}
    assert all(poisoned[7, c] == (0, "warn", "unknown") for c in on_page)
    assert poisoned[7, "robots_txt"] == alone[7, "robots_txt"] and poisoned[7, "llms_txt"] == alone[7, "llms_txt"]


def test_a_site_that_was_not_reached(spark, pages):
    """Of site 5 the homepage failed: the checks of the page fall back, those of other responses do not."""
    got = by_check(report.audit_rows(evidence(spark, pages), relation(spark, "rubric")))
    assert got[5, "html_structure"] == got[5, "canonical"] == got[5, "pagespeed"] == (0, "warn", "unknown") and got[5, "wikipedia"][2] in ("verified", "unknown") and got[5, "robots_txt"][2] == "inferred"


def test_rows_beyond_the_rubric_fall_back(spark, pages):
    """A check that gives impossible points or an unknown state is replaced there; one of another shape is refused."""
    e = evidence(spark, pages)

    def odd(e):
        return e.sites.select("site_id", F.when(F.col("site_id") == 1, 99).when(F.col("site_id") == 2, -1).otherwise(2).cast("long").alias("score"), F.when(F.col("site_id") == 3, "great").otherwise("partial").alias("state"), F.lit("verified").alias("evidence"))

    rubric = relation(spark, "rubric").where("check_name in ('ssr', 'social')")
    got = by_check(report.audit_rows(e, rubric, {"ssr": odd}))
    assert [got[k, "ssr"][0] for k in range(5)] == [2, 0, 0, 0, 2] and got[3, "ssr"] == got[4, "social"] == (0, "warn", "unknown") and got[4, "ssr"] == (2, "partial", "verified")
    with pytest.raises(TypeError, match="ssr gives"):
        report.audit_rows(e, rubric, {"ssr": lambda e: e.sites.select("site_id")})


def test_scores(spark):
    rows = spark.createDataFrame([(1, "a", 3, 4, "verified"), (1, "b", 0, 6, "unknown"), (2, "a", 1, 4, "verified"), (2, "b", 6, 6, "inferred"), (3, "a", 0, 4, "unknown")], "site_id long, check_name string, score long, max_score long, evidence string")
    assert {tuple(r) for r in report.site_scores(rows).collect()} == {(1, 3, 1, 75, 100), (2, 7, 0, 70, 67), (3, 0, 1, 0, 33)}


def test_faults_of_pages(spark):
    rows = dom(spark.createDataFrame([(1, GOOD), (2, POISON), (3, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert [(r.fault, len(r.nodes) > 0, r.html_bytes) for r in rows] == [(None, True, len(GOOD)), ("AssertionError", False, len(POISON)), (None, False, 0)]
