"""robots.txt policy over a table (site_id, body): groups, crawler access, weighted score, quality, content signals.

Null and empty bodies have no lines, no groups and no access rows; sites without an id meet nothing in joins. Repeated sites are read as one in what is told of groups. Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVERSIZE = 500 * 1024
#: Fixed values.
SIGNALS = ("ai-input", "ai-train", "search", "tdm-reservation")
SIGNAL_KEYS = ("content-signal", "content-signals")


def lines(robots: DataFrame) -> DataFrame:
    """(site_id, line_no, raw, line, key, value, has_key): comments are cut off; the key is lower-cased."""
    out = robots.select("site_id", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n|\n|\r")).alias("line_no", "raw"))
    out = out.withColumn("line", F.trim(F.split("raw", "#")[0]))
    colon = F.instr("line", ":")
    return out.select(
        "site_id", F.col("line_no").cast("long").alias("line_no"), "raw", "line", (colon > 0).alias("has_key"),
        F.when(colon > 0, F.lower(F.trim(F.substring_index("line", ":", 1)))).alias("key"), F.when(colon > 0, F.trim(F.expr("substring(line, instr(line, ':') + 1)"))).alias("value"),
    )


def _in_order():
    return Window.partitionBy("site_id").orderBy("line_no")


def groups(robots: DataFrame) -> DataFrame:
    """(site_id, group_id, agents, rules) in order: a user-agent line after a rule begins a group, a blank line does not end one."""
    rows = lines(robots).where(F.col("key").isin("user-agent", "allow", "disallow"))
    agent = F.col("key") == "user-agent"
    rows = rows.withColumn("begins", agent & (F.coalesce(F.lag("key").over(_in_order()), F.lit("allow")) != "user-agent"))
    rows = rows.withColumn("group_id", F.sum(F.col("begins").cast("long")).over(_in_order())).where("group_id > 0")
    listed = rows.groupBy("site_id", "group_id").agg(
        F.sort_array(F.collect_list(F.when(agent, F.struct("line_no", F.lower("value").alias("v"))))).alias("a"),
        F.sort_array(F.collect_list(F.when(~agent, F.struct("line_no", F.concat_ws(":", "key", F.lower("value")).alias("v"))))).alias("r"),
    )
    return listed.select("site_id", "group_id", F.col("a.v").alias("agents"), F.col("r.v").alias("rules"))


def _entries(robots: DataFrame) -> DataFrame:
    """Rules as a matcher reads them, where a blank line ends an entry: (site_id, entry, agents, rules on "/")."""
    kind = F.when(F.col("raw") == "", "blank").when(F.col("key") == "user-agent", "agent").when(F.col("key").isin("allow", "disallow"), "rule")
    rows = lines(robots).withColumn("kind", kind).where("kind is not null")
    rows = rows.withColumn("begins", (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(_in_order()), F.lit("blank")) != "agent"))
    rows = rows.withColumn("entry", F.sum(F.col("begins").cast("long")).over(_in_order()))
    last = F.last(F.when(F.col("kind") != "rule", F.col("kind")), ignorenulls=True).over(_in_order())
    rows = rows.withColumn("live", (F.col("kind") == "agent") | ((F.col("kind") == "rule") & (last == "agent"))).where("live")
    hit = (F.col("kind") == "rule") & ((F.col("value") == "*") | (F.col("value") == "") | (F.col("value") == "/"))
    out = rows.groupBy("site_id", "entry").agg(
        F.collect_set(F.when(F.col("kind") == "agent", F.lower("value"))).alias("agents"), F.count_if(F.col("kind") == "rule").alias("n"),
        F.min_by(F.when((F.col("key") == "allow") | (F.col("value") == ""), True).otherwise(False), F.when(hit, F.col("line_no"))).alias("allowed"),
    )
    return out.where("n > 0").drop("n")


def access(robots: DataFrame, crawlers: DataFrame) -> DataFrame:
    """(site_id, bot, purpose, access) of every scored crawler for the root of every site with a robots body."""
    sites = robots.where(F.trim(F.coalesce("body", F.lit(""))) != "").select("site_id").join(F.broadcast(crawlers.where("scored").select("bot", "purpose")))  # a fixed dimension
    named = groups(robots).groupBy("site_id").agg(F.array_distinct(F.flatten(F.collect_list("agents"))).alias("named"))
    star = F.array_contains("agents", "*")
    ruled = _entries(robots).groupBy("site_id").agg(
        F.sort_array(F.collect_list(F.when(~star, F.struct("entry", "agents", "allowed")))).alias("own"), F.min_by(F.struct("allowed"), F.when(star, F.col("entry"))).alias("other")
    )
    rows = sites.join(named, "site_id", "left").join(ruled, "site_id", "left")
    low = F.lower("bot")
    fits = F.filter(F.coalesce("own", F.array().cast("array<struct<entry:bigint,agents:array<string>,allowed:boolean>>")), lambda e: F.exists(e["agents"], lambda a: F.contains(low, a)))
    allowed = F.coalesce(F.when(F.size(fits) > 0, F.element_at(fits, 1)["allowed"]).otherwise(F.col("other.allowed")), F.lit(True))
    mention = F.when(F.array_contains("named", low), "explicit").when(F.array_contains("named", "*"), "wildcard")
    state = F.when(mention.isNull(), "not_mentioned").otherwise(F.concat(mention, F.when(allowed, "_allowed").otherwise("_blocked")))
    return rows.select("site_id", "bot", "purpose", state.alias("access"))


def access_score(robots: DataFrame, crawlers: DataFrame, purposes: DataFrame, points: DataFrame) -> DataFrame:
    """Weighted mean over purposes of the mean points of their crawlers, on a scale of six, half-even."""
    rows = access(robots, crawlers).join(F.broadcast(points), "access").join(F.broadcast(purposes), "purpose")
    mean = rows.groupBy("site_id", "purpose", "weight").agg(F.avg("points").alias("m"), F.count_if(F.col("access").endswith("blocked")).alias("b"))
    total = F.round(F.sum(F.col("m") * F.col("weight")) / F.sum("weight") * 6, 9)
    return mean.groupBy("site_id").agg(F.bround(total, 0).cast("long").alias("score"), F.sum("b").alias("blocked"))


def quality(robots: DataFrame) -> DataFrame:
    """Counts of faults in every robots body, and the penalty (0 to 2)."""
    rows = lines(robots)
    agents = F.sum((F.col("key") == "user-agent").cast("long")).over(_in_order())
    rows = rows.withColumn("agents", F.coalesce(agents, F.lit(0)))
    rule, delay = F.col("key").isin("allow", "disallow"), F.col("key") == "crawl-delay"
    number = F.expr("try_cast(value as double)")
    bad = (F.col("line") != "") & (~F.col("has_key") | (F.col("key") == "") | ((rule | delay) & (F.col("agents") == 0)))
    last_rule, last_agent = F.max(F.when(rule & (F.col("agents") > 0), F.col("line_no"))), F.max(F.when(F.col("key") == "user-agent", F.col("line_no")))
    out = rows.groupBy("site_id").agg(
        F.count_if(bad).alias("malformed"),
        F.count_if((F.col("key") == "sitemap") & ~F.col("value").rlike("(?i)^https?://[^/?#]+")).alias("bad_sitemaps"),
        F.count_if(delay).alias("delays"), F.count_if(delay & F.coalesce(number < 0, F.lit(True))).alias("bad_delays"),
        F.when(last_agent.isNotNull() & (F.coalesce(last_rule, F.lit(-1)) < last_agent), 1).otherwise(0).cast("long").alias("empty_groups"),
    )
    out = out.join(robots.select("site_id", F.octet_length(F.coalesce("body", F.lit(""))).cast("long").alias("bytes")), "site_id")
    faults = [F.col("bytes") > OVERSIZE, (F.col("malformed") > 0) | (F.col("empty_groups") > 0), F.col("bad_sitemaps") > 0, F.col("bad_delays") > 0]
    return out.withColumn("penalty", F.least(F.lit(2), sum((f.cast("int") for f in faults), F.lit(0))).cast("long"))


def content_signals(robots: DataFrame) -> DataFrame:
    """(site_id, token) of every content signal named in a robots body."""
    rows = lines(robots).where(F.col("key").isin(*SIGNAL_KEYS))
    return rows.select("site_id", F.explode(F.filter(F.array(*map(F.lit, SIGNALS)), lambda t: F.contains(F.lower("value"), t))).alias("token")).distinct()
