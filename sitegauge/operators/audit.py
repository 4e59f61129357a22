"""From raw pages to scored sites: the checks that pages alone can feed, fallback rows for the others, and a rank among all hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions.html import host
from sitegauge.runtime import cut
from sitegauge.sources.dom import dom

from .pages import readability
from .site_checks import entity_coherence, html_structure, indexing, structured_data, with_json_ld

#: Checks that a homepage decides alone, and the evidence level of their rows.
ON_PAGE = {"html_structure": "inferred", "schema_ld": "inferred", "indexing": "inferred", "social": "verified"}


def with_fallbacks(rows: DataFrame, rubric: DataFrame, key: str = "host") -> DataFrame:
    """Check rows with a row for every check of the rubric: a check that gave none is ``warn``, of unknown evidence, without points. The rubric (13 rows) is broadcast."""
    every = rows.select(key).distinct().join(F.broadcast(rubric))
    out = every.join(rows, [key, "check_name"], "left")
    return out.select(
        key, "pillar", "check_name", F.coalesce("score", F.lit(0)).cast("long").alias("score"), "max_score", F.coalesce("state", F.lit("warn")).alias("state"), F.coalesce("evidence", F.lit("unknown")).alias("evidence")
    )


def home_rows(pages: DataFrame) -> DataFrame:
    """(host, page_id, url, html) of each host's page of least page_id (then of least url and html, so repeated ids give one row); a partial minimum."""
    p = pages.where("page_id is not null").select(host(F.col("url")).alias("host"), F.struct("page_id", "url", "html").alias("x")).where("host <> ''")
    return p.groupBy("host").agg(F.min("x").alias("x")).select("host", "x.*")


def page_checks(pages: DataFrame) -> DataFrame:
    """(host, check_name, score, state, evidence) of the checks that a host's homepage decides without its response."""
    home = cut(home_rows(pages))  # one page a host; read by each check
    ssr = readability(home, "host").select("host", F.lit("ssr").alias("check_name"), "score", "state", F.when(F.col("state") == "pass", "verified").otherwise("inferred").alias("evidence"))
    # hosts stand in for ids: one row a host
    d = cut(with_json_ld(dom(home.select(F.col("host").alias("page_id"), "url", "html", F.create_map().cast("map<string,string>").alias("headers")))))
    out = ssr
    for name, check in (("html_structure", html_structure), ("schema_ld", structured_data), ("indexing", indexing), ("social", entity_coherence)):
        out = out.unionByName(check(d).select(F.col("page_id").alias("host"), F.lit(name).alias("check_name"), "score", "state", F.lit(ON_PAGE[name]).alias("evidence")))
    return out


def site_audit(pages: DataFrame, rubric: DataFrame) -> DataFrame:
    """Points, evidence percentage and inclusive percentile of every host; the percentiles come from at most 101 counts."""
    rows = with_fallbacks(cut(page_checks(pages)), rubric)  # read twice there
    known = F.col("evidence") != "unknown"
    sites = rows.groupBy("host").agg(
        F.sum("score").alias("overall"), F.count_if(~known).alias("unknown_checks"), F.bround(F.sum(F.when(known, F.col("score"))) / F.sum(F.when(known, F.col("max_score"))) * 100, 0).cast("long").alias("percent")
    )
    counts = sites.groupBy("percent").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("percent").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())
    ranks = counts.select("percent", F.bround(upto * 100, 0).cast("long").alias("percentile"))
    return sites.join(F.broadcast(ranks), "percent").select("host", "overall", "unknown_checks", "percent", "percentile")
