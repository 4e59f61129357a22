"""Operators over declared metadata: JSON-LD, lastmod dates, viewports, canonical links, trust and social links, prices, addresses.

Null values are missing ones. Repeated rows give a row each, or count each in sums; a null site is a site of its own in sums and meets nothing in joins. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
TRUST = {
    "about": "about|company|mission|team|our story|who we are", "contact": "contact|contact us|get in touch|locations?", "privacy": "privacy", "terms": "terms|terms of service|terms and conditions|legal",
    "support": "support|help center|customer service|faqs?", "returns": "returns?|return policy|refunds?|exchanges?", "shipping": "shipping|delivery|fulfillment",
}
SOCIAL = {
    "Instagram": r"instagram\.com/[\w.\-]+", "TikTok": r"tiktok\.com/@[\w.\-]+", "Facebook": r"facebook\.com/[\w.\-]+", "X/Twitter": r"(twitter\.com|x\.com)/[\w.\-]+",
    "YouTube": r"youtube\.com/(channel/|c/|user/|@)[\w.\-]+", "LinkedIn": r"linkedin\.com/company/", "Pinterest": r"pinterest\.com/[\w.\-]+", "Reddit": r"reddit\.com/(r|user)/",
    "Medium": r"medium\.com/@?[\w\-]+", "Substack": r"[\w\-]+\.substack\.com",
}
PRIVATE = r"^(0|10|127)\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^198\.(1[89]|51\.100)\.|^203\.0\.113\.|^(22[4-9]|2[34][0-9]|25[0-5])\."
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def json_ld_nodes(scripts: DataFrame) -> DataFrame:
    """(site_id, script_no, types, fields): typed nodes of each script, through lists and @graph two levels down.

    ``fields`` maps names to their JSON text. Scripts that are no JSON give no node.
    """
    objects = scripts.select("site_id", "script_no", F.trim("body").alias("j"))
    out = None
    for _ in range(3):
        listed = objects.where(F.startswith("j", F.lit("["))).select("site_id", "script_no", F.explode(F.from_json("j", "array<string>")).alias("j"))
        single = objects.where(F.startswith("j", F.lit("{"))).unionByName(listed.where(F.startswith("j", F.lit("{")))).select("site_id", "script_no", F.from_json("j", "map<string,string>").alias("m"))
        found = single.where(F.col("m")["@type"].isNotNull())
        out = found if out is None else out.unionByName(found)
        objects = single.where(F.col("m")["@graph"].isNotNull()).select("site_id", "script_no", F.col("m")["@graph"].alias("j"))
    kind = F.col("m")["@type"]
    types = F.when(F.startswith(kind, F.lit("[")), F.from_json(kind, "array<string>")).otherwise(F.array(kind))
    return out.select("site_id", "script_no", types.alias("types"), F.col("m").alias("fields"))


def json_ld_best(scripts: DataFrame, fields: DataFrame) -> DataFrame:
    """The JSON-LD score of each site (0 to 5), with the best node's type: five less two for a required and one for a recommended
    field that is missing (two at most), three at least with all required ones and one without."""
    nodes = json_ld_nodes(scripts).withColumn("node", F.monotonically_increasing_id())
    known = nodes.select("site_id", "node", F.posexplode("types").alias("k", "type"), "fields").join(F.broadcast(fields), "type")
    value = F.trim(F.element_at("fields", F.col("field")))
    missing = value.isNull() | value.isin("", "[]", "null")
    per = known.groupBy("site_id", "node", "k", "type").agg(F.count_if(missing & F.col("required")).alias("req"), F.count_if(missing & ~F.col("required")).alias("rec"))
    first = per.groupBy("site_id", "node").agg(F.min_by(F.struct("type", "req", "rec"), "k").alias("x"))
    score = F.greatest(F.when(F.col("x.req") > 0, 1).otherwise(3), 5 - 2 * F.col("x.req") - F.least("x.rec", F.lit(2)))
    scored = nodes.join(first, ["site_id", "node"], "left").select("site_id", F.coalesce(score, F.lit(2)).cast("long").alias("points"), F.coalesce("x.type", F.lit("other")).alias("type"))
    best = scored.groupBy("site_id").agg(F.max("points").alias("points"), F.min_by("type", F.struct(-F.col("points"), "type")).alias("type"))
    parsed = F.when(F.startswith(F.trim("body"), F.lit("[")), F.from_json("body", "array<string>").isNotNull()).otherwise(F.from_json("body", "map<string,string>")["@type"].isNotNull() | F.from_json("body", "map<string,string>")["@graph"].isNotNull())
    tried = scripts.groupBy("site_id").agg(F.count("*").alias("scripts"), F.count_if(~F.coalesce(parsed, F.lit(False))).alias("invalid"))
    out = tried.join(best, "site_id", "left")
    return out.select("site_id", "scripts", "invalid", F.coalesce("points", F.when(F.col("invalid") > 0, 1).otherwise(0)).cast("long").alias("score"), "type")


def lastmod_quality(rows: DataFrame, as_of: str) -> DataFrame:
    """Sitemap entries per site: missing, invalid and future lastmod values as of a given day."""
    day = F.expr("try_to_date(substring(value, 1, 10), 'yyyy-MM-dd')")
    filled = F.coalesce(F.trim("value"), F.lit("")) != ""
    d = F.when(F.col("value").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), day)
    return rows.groupBy("site_id").agg(
        F.count("*").alias("entries"), F.count_if(~filled).alias("missing"), F.count_if(filled & d.isNull()).alias("invalid"), F.count_if(d > F.to_date(F.lit(as_of))).alias("future"), F.max(F.when(d <= F.to_date(F.lit(as_of)), d)).alias("latest")
    )


def viewport(rows: DataFrame) -> DataFrame:
    """The mobile-viewport points (0, 2, 4): no tag, a fault, or neither."""
    tokens = F.expr("transform(split(lower(content), ','), x -> trim(x))")
    width = F.exists(tokens, lambda t: t.rlike(r"^width\s*=\s*device-width$"))
    fixed = F.exists(tokens, lambda t: t.rlike(r"^user-scalable\s*=\s*(no|0)$"))
    scale = F.expr("try_cast(regexp_extract(lower(content), 'maximum-scale\\\\s*=\\\\s*([0-9.]+)', 1) as double)")
    zoom = fixed | F.coalesce(scale <= 1, F.lit(False))
    return rows.select("site_id", F.when(F.trim("content") == "", 0).when(~width | zoom, 2).otherwise(4).cast("long").alias("points"), zoom.alias("zoom_limited"))


def canonical(rows: DataFrame) -> DataFrame:
    """Canonical faults and score (5, 3 or 1): plain http kept, tag missing or different, other host answering as itself."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(c, "[?#].*$", ""), "/+$", "")
    host = F.regexp_extract("final_url", "^[a-z]+://([^/?#]+)", 1)
    plain = ~F.startswith("http_final", F.lit("https://"))
    tag = F.col("canonical").isNull() | (norm("canonical") != norm("final_url"))
    other = F.coalesce(F.col("other_host") != host, F.lit(False))
    n = plain.cast("int") + tag.cast("int") + other.cast("int")
    out = rows.select("site_id", plain.alias("plain_http"), tag.alias("bad_tag"), other.alias("two_hosts"), n.cast("long").alias("issues"))
    return out.withColumns({"score": F.when(F.col("issues") == 0, 5).when(F.col("issues") == 1, 3).otherwise(1).cast("long"), "state": F.when(F.col("issues") == 0, "pass").when(F.col("issues") == 1, "partial").otherwise("fail")})


def _kinds(rows: DataFrame, text, patterns: dict[str, str]) -> DataFrame:
    found = F.explode(F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items()]), lambda k: k.isNotNull()))
    return rows.select("site_id", found.alias("kind")).groupBy("site_id", "kind").agg(F.count("*").alias("links"))


def trust_surfaces(rows: DataFrame) -> DataFrame:
    """(site_id, kind, links): pages about the publisher that a site links to, by words of path and label."""
    path = F.regexp_extract("href", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.concat_ws(" ", path, "label")), "[^a-z0-9]+", " "), F.lit(" "))
    return _kinds(rows, text, {k: f" ({p}) " for k, p in TRUST.items()})


def social_profiles(rows: DataFrame) -> DataFrame:
    """(site_id, kind, links): profiles on social platforms among a site's links."""
    return _kinds(rows, F.lower("href"), {k: p.lower() for k, p in SOCIAL.items()})


def prices(rows: DataFrame) -> DataFrame:
    """Shown and declared price as decimals, whatever the separators, and whether they agree."""

    def amount(c: str):
        t = F.regexp_replace(c, "[^0-9.,]", "")
        point = F.when(t.rlike(r"^[0-9.]*,[0-9]{1,2}$"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
        return point.try_cast("decimal(18,4)")

    out = rows.select("site_id", amount("shown").alias("shown"), amount("declared").alias("declared"))
    return out.select("site_id", F.col("shown").cast("double").alias("shown"), F.col("declared").cast("double").alias("declared"), (F.col("shown") == F.col("declared")).alias("same"))


def public_addresses(rows: DataFrame) -> DataFrame:
    """Whether each IPv4 address is one that may be fetched: well formed and in no private, local or reserved range."""
    formed = F.col("ip").rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    return rows.select("site_id", "ip", (formed & ~F.col("ip").rlike(PRIVATE)).alias("public"))
