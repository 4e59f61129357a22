"""Operators over side evidence: routing of crawler fetches, DNS answers, surface bodies, commerce fields, cached lookups, reports.

Null fields differ from all others but null; null bodies are not valid. Repeated rows give a row each, or one where the last or greatest is taken; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scoring import with_rubric

#: Fixed values.
DNS_TOKENS = ("agent", "mcp", "a2a", "aid")
JSON_SURFACES = ("API description", "API catalog", "ARD catalog", "OAuth authorization metadata", "OAuth protected resource metadata", "Web Bot Auth directory", "MCP server card", "A2A agent card", "Agent skills", "WebMCP manifest", "catalog JSON")
COMPARED = ("product_name", "price", "availability", "sku_or_gtin")
TTL_DAYS = 30


def _far(value, base, least: int):
    return (base >= least) & ((value < base * 0.6) | (value > base * 1.6))


def routing(rows: DataFrame) -> DataFrame:
    """What differs between each crawler's fetch and the browser's of the same site; crawlers without a difference have no row."""
    base = rows.where("bot = 'browser'").select("site_id", *[F.col(c).alias(f"b_{c}") for c in ("status", "final_url", "canonical", "bytes", "words")])
    both = rows.where("bot <> 'browser'").join(base, "site_id")
    found = F.filter(
        F.array(
            F.when(~F.col("status").eqNullSafe(F.col("b_status")), "status"), F.when(~F.col("final_url").eqNullSafe(F.col("b_final_url")), "final_url"), F.when(~F.col("canonical").eqNullSafe(F.col("b_canonical")), "canonical"),
            F.when(_far(F.col("bytes"), F.col("b_bytes"), 1024), "bytes"), F.when(_far(F.col("words"), F.col("b_words"), 80), "words"),
        ),
        lambda x: x.isNotNull(),
    )
    return both.select("site_id", "bot", F.array_join(found, ",").alias("differs")).where("differs <> ''")


def dns_discovery(rows: DataFrame) -> DataFrame:
    """Sites with a TXT answer that names an agent token."""
    hit = F.lit(False)
    for t in DNS_TOKENS:
        hit = hit | F.contains(F.lower("txt"), F.lit(t))
    return rows.where(F.col("rtype") == "TXT").groupBy("site_id").agg(F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("name"))).alias("first_name"))


def surface_validity(rows: DataFrame) -> DataFrame:
    """Whether each body is what its kind of surface holds: JSON, a feed, a titled text, or simply enough text."""
    t = F.regexp_replace("body", r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    json = F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<string>").isNotNull()).when(F.startswith(t, F.lit("{")), F.size(F.from_json(t, "map<string,string>")) > 0)
    feed = t.rlike(r"(?i)^(<\?xml[^>]*>\s*)?<(rss|feed|rdf:rdf)[\s>]")
    text = F.startswith(t, F.lit("#")) | F.contains(F.lower(t), F.lit("authorization"))
    valid = F.when(F.col("kind").isin(*JSON_SURFACES), F.coalesce(json, F.lit(False))).when(F.col("kind") == "content feed", feed).when(F.col("kind") == "auth.md", text).otherwise(True)
    return rows.select("site_id", "kind", F.length("body").cast("long").alias("chars"), ((F.length(t) >= 20) & valid).alias("valid"))


def commerce_mismatches(rows: DataFrame) -> DataFrame:
    """Fields that one side has and the other has not, or that both have with different values where values are compared."""
    value = F.nullif(F.lower(F.trim(F.regexp_replace("value", r"\s+", " "))), F.lit(""))
    sides = rows.groupBy("site_id", "field").agg(F.max(F.when(F.col("side") == "visible", value)).alias("v"), F.max(F.when(F.col("side") == "schema", value)).alias("s"))
    differ = F.col("field").isin(*COMPARED) & (F.col("v") != F.col("s"))
    kind = F.when(F.col("v").isNull() & F.col("s").isNull(), None).when(F.col("v").isNull(), "schema only").when(F.col("s").isNull(), "visible only").when(differ, "different")
    return sides.select("site_id", "field", kind.alias("mismatch")).where("mismatch is not null")


def cached(rows: DataFrame, as_of: str) -> DataFrame:
    """The last lookup of each key, and whether it is fresh on a given day; one of exactly the time to live is not."""
    last = rows.groupBy("cache_key").agg(F.max_by(F.struct("checked", "score"), "checked").alias("x"))
    age = F.datediff(F.to_date(F.lit(as_of)), F.to_date("x.checked"))
    return last.select("cache_key", F.col("x.score").alias("score"), age.cast("long").alias("age_days"), (age < TTL_DAYS).alias("fresh"))


def report_json(rows: DataFrame, rubric: DataFrame) -> DataFrame:
    """One row per site with its checks as JSON, ordered by name."""
    item = F.struct("check_name", "pillar", "state", "score", "max_score")
    out = with_rubric(rows, rubric).groupBy("site_id").agg(F.sort_array(F.collect_list(item)).alias("checks"))
    return out.select("site_id", F.to_json("checks").alias("checks"))


def best_per_pillar(rows: DataFrame, rubric: DataFrame) -> DataFrame:
    """The check with the most missing points of each site and pillar, ties by name."""
    w = Window.partitionBy("site_id", "pillar").orderBy(F.desc(F.col("max_score") - F.col("score")), "check_name")
    out = with_rubric(rows, rubric).where("state <> 'pass'").withColumn("k", F.row_number().over(w)).where("k = 1")
    return out.select("site_id", "pillar", "check_name", (F.col("max_score") - F.col("score")).alias("missing"))
