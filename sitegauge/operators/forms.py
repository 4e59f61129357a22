"""Operators over forms, urls, entity lookups and page blurbs.

Null markup, urls and texts say nothing (no form, null forms of urls, a missing title or description). Repeated rows count each; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .site_search import placeholder

#: Fixed values.
NO_FIELD = ("hidden", "submit", "button", "reset", "image")
GENERIC_NAMES = ("", "field", "input", "value", "data", "form", "formfield", "form_field")
PURPOSES = ("address", "city", "company", "country", "email", "family-name", "first-name", "given-name", "last-name", "name", "organization", "phone", "postal", "tel", "username", "zip")


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in an opening tag, lower-cased and trimmed; empty where it is not there."""
    return F.lower(F.trim(F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']?([^"'>]*)["']?""", 1)))


def form_faults(pages: DataFrame) -> DataFrame:
    """Counts of what keeps an agent from using the forms of a page (site_id, html)."""
    forms = F.regexp_extract_all("html", F.lit(r"(?is)<form(?:\s[^>]*)?>.*?</form\s*>"), F.lit(0))
    rows = pages.select("site_id", F.explode(forms).alias("f")).withColumn("open", F.regexp_extract("f", r"(?is)^<form(?:\s[^>]*)?>", 0))
    fields = F.filter(
        F.regexp_extract_all("f", F.lit(r"(?is)<(?:input|select|textarea)(?:\s[^>]*)?>"), F.lit(0)), lambda t: ~t.rlike("(?i)^<input") | ~attribute(t, "type").isin(*NO_FIELD)
    )
    rows = rows.select("site_id", attribute(F.col("open"), "action").alias("action"), attribute(F.col("open"), "method").alias("method"), fields.alias("fields"), F.col("f").rlike(r"(?i)<button|<input[^>]*type=[\"']?submit").alias("submits"))
    needs = F.filter("fields", lambda t: t.rlike("(?i)^<input") & (attribute(t, "type").isin("email", "tel", "url", "password") | F.concat_ws(" ", attribute(t, "name"), attribute(t, "id"), attribute(t, "placeholder")).rlike("|".join(PURPOSES))))
    scripted = F.col("action").rlike("^(javascript:|#)")
    method = F.col("method").isin("get", "post", "dialog")
    return rows.groupBy("site_id").agg(
        F.count("*").alias("forms"), F.count_if(F.col("action") == "").alias("no_action"), F.count_if(scripted).alias("script_only"), F.count_if(F.col("method") == "").alias("no_method"),
        F.count_if((F.col("method") != "") & ~method).alias("odd_method"), F.sum(F.size(F.filter("fields", lambda t: attribute(t, "name").isin(*GENERIC_NAMES)))).cast("long").alias("unnamed_fields"),
        F.sum(F.size(F.filter(needs, lambda t: attribute(t, "autocomplete").isin("", "off")))).cast("long").alias("no_autocomplete"), F.count_if(~F.col("submits")).alias("no_submit"),
        F.count_if((F.col("action") != "") & ~scripted & method).alias("usable"),
    )


def normal_urls(rows: DataFrame) -> DataFrame:
    """Two normal forms of absolute http(s) urls (null for others): without query and default port, and with the query kept."""
    scheme, host = F.lower(F.regexp_extract("url", "^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract("url", r"^[^?#]*(\?[^#]*)", 1)
    plain = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    ok = scheme.isin("http", "https") & (host != "")
    return rows.select("site_id", F.when(ok, F.concat(scheme, F.lit("://"), plain, path)).alias("page_key"), F.when(ok, F.concat(scheme, F.lit("://"), host, path, query)).alias("exact_key"))


def entity_score(lookups: DataFrame, entities: DataFrame) -> DataFrame:
    """Score (0 to 4) of each site's entity: both sources 4, one 3 or 2, none 0; 2 and unknown where the lookup failed."""
    rows = lookups.join(entities, "name", "left")
    failed = F.coalesce(F.col("status"), F.lit(0)) != 200
    a, b = F.coalesce("in_wikidata", F.lit(False)), F.coalesce("in_wikipedia", F.lit(False))
    score = F.when(failed | (~a & b), 2).when(a & b, 4).when(a, 3).otherwise(0)
    state = F.when(failed, "warn").when(a & b, "pass").when(a | b, "partial").otherwise("fail")
    return rows.select("site_id", score.cast("long").alias("score"), state.alias("state"), F.when(failed, "unknown").otherwise("verified").alias("evidence"))


def blurb_faults(rows: DataFrame) -> DataFrame:
    """Per site: pages, missing titles and descriptions, too short and too long ones, placeholders, and pages that share a description."""
    d = F.col("description")
    shared = rows.where(d.isNotNull()).groupBy("site_id", F.lower("description").alias("k")).agg(F.count("*").alias("n")).where("n > 1").groupBy("site_id").agg(F.sum("n").alias("shared"))
    out = rows.groupBy("site_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("title").isNull()).alias("no_title"), F.count_if(d.isNull()).alias("no_description"), F.count_if(F.length(d) < 50).alias("short"), F.count_if(F.length(d) > 200).alias("long"),
        F.count_if(placeholder(d)).alias("placeholder"),
    )
    return out.join(shared, "site_id", "left").fillna(0, ["shared"])


def with_locked(rows: DataFrame, rubric: DataFrame, locked: DataFrame) -> DataFrame:
    """Scored and locked rows of every site by pillar: points, most that can be had here, and most in all."""
    scored = rows.join(F.broadcast(rubric), "check_name").groupBy("site_id", "pillar").agg(F.sum("score").alias("points"), F.sum("max_score").alias("open_most"))
    more = locked.groupBy("pillar").agg(F.sum("max_score").alias("locked_most"))
    return scored.join(F.broadcast(more), "pillar", "left").select("site_id", "pillar", "points", "open_most", F.coalesce("locked_most", F.lit(0)).alias("locked_most"), (F.col("open_most") + F.coalesce("locked_most", F.lit(0))).alias("most"))
