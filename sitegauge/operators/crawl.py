"""Operators over crawl evidence: crawler fetches, indexing directives, hreflang links.

Null statuses are failed fetches, null titles and values say nothing. Repeated rows of a key count once where the last attempt or distinct pairs decide, else each; sites with
a null id are told of in sums but meet no other row in joins. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import html as H

BLOCK_STATUS = (401, 403, 429, 503)
PROBED = 9


def bot_access(fetches: DataFrame) -> DataFrame:
    """Why each crawler is blocked (null: it is not); rows (site_id, bot, attempt, status, words, title). The last attempt counts.

    Each site's browser row is its baseline: a captcha title that it shows too blocks nobody, and a body is thin below a quarter of
    its words (20 at least) where it has 80 or more.
    """
    last = fetches.groupBy("site_id", "bot").agg(F.max_by(F.struct("status", "words", "title"), "attempt").alias("x")).select("site_id", "bot", "x.*")
    base = last.where("bot = 'browser'").select("site_id", F.col("words").alias("base_words"), F.contains(F.lower("title"), F.lit("captcha")).alias("base_captcha"))
    rows = last.where("bot <> 'browser'").join(base, "site_id", "left")
    captcha = F.contains(F.lower("title"), F.lit("captcha")) & ~F.coalesce("base_captcha", F.lit(False))
    thin = (F.col("base_words") >= 80) & (F.col("words") < F.greatest(F.lit(20.0), F.col("base_words") * 0.25))
    reason = F.when(F.col("status").isNull(), "error").when(F.col("status").isin(*BLOCK_STATUS), F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(captcha, "challenge").when(thin, "thin")
    return rows.select("site_id", "bot", reason.alias("reason"))


def bot_score(fetches: DataFrame) -> DataFrame:
    rows = bot_access(fetches).groupBy("site_id").agg(F.count_if(F.col("reason").isNull()).alias("open"), F.count("*").alias("probed"))
    state = F.when(F.col("open") == F.col("probed"), "pass").when(F.col("open") > 0, "partial").otherwise("fail")
    return rows.select("site_id", "open", "probed", F.bround(F.col("open") / F.col("probed") * 6, 0).cast("long").alias("score"), state.alias("state"))


def directives(rows: DataFrame) -> DataFrame:
    """(site_id, crawler or null, directive) of X-Robots-Tag values."""
    part = F.explode(F.split(F.lower("value"), ","))
    rows = rows.select("site_id", part.alias("d")).select("site_id", F.regexp_replace(F.trim(F.regexp_replace("d", r"\s+", " ")), r"\s*:\s*", ":").alias("d")).where("d <> ''")
    scoped = F.col("d").rlike("^(googlebot|bingbot|duckduckbot|duckassistbot|googlebot-news|googlebot-image|googlebot-video|otherbot):.")
    return rows.select(
        "site_id", F.when(scoped, F.substring_index("d", ":", 1)).alias("crawler"), F.when(scoped, F.expr("substring(d, instr(d, ':') + 1)")).otherwise(F.col("d")).alias("directive")
    )


def indexing(rows: DataFrame) -> DataFrame:
    """The indexing score (0 to 5) by precedence of the directives; a site without any has 5."""
    d = F.col("directive")
    found = directives(rows).groupBy("site_id").agg(
        F.bool_or(d.isin("noindex", "none")).alias("blocked"), F.bool_or(d.isin("nosnippet", "noimageindex", "max-snippet:0", "max-image-preview:none", "max-video-preview:0")).alias("snippet"),
        F.bool_or(d == "max-image-preview:standard").alias("standard"), F.bool_or(d.isin("nofollow", "noarchive", "notranslate") | d.startswith("unavailable_after:")).alias("restricted"),
    )
    score = F.when(F.col("blocked"), 0).when(F.col("snippet"), 2).when(F.col("standard"), 4).when(F.col("restricted"), 3).otherwise(5)
    out = rows.select("site_id").join(found, "site_id", "left").withColumn("score", score.cast("long"))
    return out.select("site_id", "score", F.when(F.col("score") == 5, "pass").when(F.col("score") == 0, "fail").otherwise("partial").alias("state"))


def hreflang(links: DataFrame) -> DataFrame:
    """Per site: invalid values, relative urls, pages without a link to themselves, pairs without a way back, and pairs not known."""
    rows = links.select("site_id", "lang", "href", H.url_key(F.col("src")).alias("page"), H.url_key(F.col("href")).alias("target"), F.col("href").rlike("(?i)^https?://").alias("absolute"))
    counts = rows.groupBy("site_id").agg(
        F.count_if(~((F.col("lang") == "x-default") | F.col("lang").rlike("^[a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?$"))).alias("invalid"), F.count_if(~F.col("absolute")).alias("relative")
    )
    own = rows.groupBy("site_id", "page").agg(F.bool_or(F.col("target") == F.col("page")).alias("self")).groupBy("site_id").agg(F.count_if(~F.coalesce("self", F.lit(False))).alias("no_self"))
    host = lambda c: F.substring_index(c, "/", 1)
    pairs = rows.where("absolute and lang <> 'x-default' and target <> page").where(host("page") == host("target")).select("site_id", "page", "target").distinct()
    back = rows.select("site_id", F.col("page").alias("target"), F.col("target").alias("page"), F.lit(True).alias("back")).distinct()
    known = rows.select("site_id", F.col("page").alias("target"), F.lit(True).alias("known")).distinct()
    judged = pairs.join(known, ["site_id", "target"], "left").join(back, ["site_id", "target", "page"], "left").groupBy("site_id").agg(
        F.count_if(F.col("known") & F.col("back").isNull()).alias("not_returned"), F.count_if(F.col("known").isNull()).alias("unchecked")
    )
    out = counts.join(own, "site_id").join(judged, "site_id", "left")
    return out.fillna(0, ["not_returned", "unchecked"])
