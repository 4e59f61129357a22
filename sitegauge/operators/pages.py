"""Operators over tables of raw pages (page_id, url, html).

Null html counts as empty and null urls have no host; pages without a host or an id take no part in what is told of hosts. Repeated rows count each, and an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions import html as H

READABLE_WORDS, MAIN_WORDS = 50, 80
HIGH_BOILERPLATE, HIGH_NAVIGATION, HIGH_SCRIPT, HIGH_RATIO = 0.65, 0.45, 0.5, 40.0


def text_metrics(pages: DataFrame, *keep: str) -> DataFrame:
    """Words and byte ratios of every page's raw HTML, and its rendering state; columns of ``keep`` go along. One pass, no shuffle.

    A null html is empty; null ids and repeated rows are rows like any other.
    """
    text = pages.select("page_id", *keep, F.coalesce("html", F.lit("")).alias("html")).withColumn("text", H.visible_text(F.col("html")))
    body = F.regexp_replace(F.col("html"), "(?s)<!--.*?-->", " ")
    chrome_free = body
    for tag in H.CHROME:
        chrome_free = F.regexp_replace(chrome_free, H.element(tag), " ")
    shell = (F.regexp_count(F.col("html"), F.lit(r"(?i)<script\s[^>]*src=")) >= 5) | F.col("html").rlike(r"""(?i)<[a-z][^>]*\sid=["']?(root|app|__next|__nuxt|svelte)["' >]""")
    for mark in H.APP_SHELL:
        shell = shell | F.contains(F.substring("html", 1, 20000), F.lit(mark))
    m = text.select(
        "page_id",
        *keep,
        H.words(F.col("text")).alias("visible_words"),
        F.octet_length("html").cast("long").alias("html_bytes"),
        F.octet_length("text").cast("long").alias("text_bytes"),
        F.coalesce(H.most_words_within(body, H.MAIN), H.words(H.visible_text(chrome_free))).alias("main"),
        H.words_within(body, H.CHROME).alias("chrome_words"),
        H.bytes_of_elements(F.col("html"), ("script", "style")).alias("script_style_bytes"),
        shell.alias("app_shell"),
    )
    m = m.withColumn("main_words", F.least("main", "visible_words")).drop("main")
    none = F.col("visible_words") == 0
    m = m.withColumns(
        {
            "boilerplate_ratio": F.when(none, F.lit(1.0)).otherwise((F.col("visible_words") - F.col("main_words")) / F.col("visible_words")),
            "navigation_ratio": F.when(none, F.lit(1.0)).otherwise(F.col("chrome_words") / F.col("visible_words")),
            "script_style_ratio": F.when(F.col("html_bytes") == 0, F.lit(0.0)).otherwise(F.col("script_style_bytes") / F.col("html_bytes")),
            "html_text_ratio": F.col("html_bytes") / F.greatest("text_bytes", F.lit(1)),
        }
    )
    return m.withColumn(
        "rendering",
        F.when((F.col("visible_words") < READABLE_WORDS) & F.col("app_shell"), "probable_js_shell").when(none, "blocked_or_empty").when(F.col("visible_words") >= READABLE_WORDS, "readable").otherwise("thin"),
    )


def readability(pages: DataFrame, *keep: str) -> DataFrame:
    """The raw-HTML readability check: issues, state and score (0 to 4) of every page; columns of ``keep`` go along."""
    m = text_metrics(pages, *keep)
    issues = (
        F.when(F.col("main_words") < MAIN_WORDS, 1).otherwise(0)
        + F.when(F.col("boilerplate_ratio") > HIGH_BOILERPLATE, 1).otherwise(0)
        + F.when(F.col("navigation_ratio") > HIGH_NAVIGATION, 1).otherwise(0)
        + F.when(F.col("script_style_ratio") > HIGH_SCRIPT, 1).otherwise(0)
        + F.when(F.col("html_text_ratio") > HIGH_RATIO, 1).otherwise(0)
    )
    m = m.withColumn("issues", issues.cast("long"))
    score = (
        F.when(F.col("rendering") == "readable", F.when(F.col("issues") == 0, 4).when(F.col("issues") < 3, 3).otherwise(2))
        .when(F.col("rendering") == "thin", F.when(F.col("issues") < 3, 2).otherwise(1))
        .otherwise(0)
    )
    m = m.withColumn("score", score.cast("long"))
    state = F.when(F.col("score") == 4, "pass").when(F.col("score") == 0, "fail").otherwise("partial")
    return m.select("page_id", *keep, "rendering", "visible_words", "main_words", "issues", state.alias("state"), "score")


def homepages(pages: DataFrame) -> DataFrame:
    """The page of least page_id of every host; a partial minimum, so a hot host is summed before the shuffle."""
    p = pages.where("page_id is not null").select(H.host(F.col("url")).alias("host"), "page_id", "url")
    return p.where("host <> ''").groupBy("host").agg(F.min(F.struct("page_id", "url")).alias("x"), F.count("*").alias("pages")).select("host", "x.page_id", "x.url", "pages")


def sitemap_hygiene(pages: DataFrame) -> DataFrame:
    """Each host's urls taken as its sitemap: entries, distinct entries, entries without https, repeated page keys."""
    p = pages.select("url", H.host(F.col("url")).alias("host"), H.url_key(F.col("url")).alias("key"), F.lower(F.regexp_extract("url", "^([A-Za-z]+)://", 1)).alias("scheme"))
    per_key = p.where("host <> ''").groupBy("host", "key").agg(F.count("*").alias("n"), F.count_if(F.col("scheme") != "https").alias("plain"))
    return per_key.groupBy("host").agg(
        F.sum("n").alias("entries"), F.count("*").alias("page_keys"), F.sum("plain").alias("non_https"), F.sum(F.col("n") - 1).alias("repeated"), F.max("n").alias("most_of_one_key")
    )


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """Titles that several pages of one host share."""
    title = F.lower(F.trim(F.regexp_replace(F.regexp_extract("html", H.content_of("title"), 1), H.WORD_GAP, " ")))
    p = pages.select(H.host(F.col("url")).alias("host"), title.alias("title"), "page_id")
    return p.where("title <> ''").groupBy("host", "title").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


def language_mismatch(pages: DataFrame) -> DataFrame:
    """By declared language and language of the path: how many pages."""
    declared = F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*\slang=["']?([A-Za-z-]+)""", 1))
    p = pages.select(declared.alias("declared"), F.lower(F.regexp_extract(H.path(F.col("url")), "^/([A-Za-z]{2})(?:/|$)", 1)).alias("in_path"))
    return p.groupBy("declared", "in_path").agg(F.count("*").alias("pages"), F.max((F.col("declared") != F.col("in_path")).cast("int")).cast("long").alias("mismatch"))


def host_rank(pages: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` pages of each host by readable words (ties by page_id)."""
    m = text_metrics(pages.withColumn("host", H.host(F.col("url"))), "host")
    w = Window.partitionBy("host").orderBy(F.desc("main_words"), "page_id")
    return m.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= top).select("host", "place", "page_id", "main_words")
