"""Scopes: presets with overrides, and the probes that a scope includes.

Requests with an unknown or null preset are not valid and have null dimensions; empty overrides change nothing. Repeated requests give a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("protocols", "account_auth", "ecommerce")


def resolve(requests: DataFrame, presets: DataFrame, keys: DataFrame) -> DataFrame:
    """Each request's dimensions and families: the preset's, then its overrides.

    A family that is switched on brings its dimension with it unless that is switched off by name; switching a family or dimension
    off touches nothing else. Unknown keys make the request invalid. Presets and keys are small fixed dimensions.
    """
    o = F.explode(F.split("overrides", " ")).alias("o")
    given = requests.where("overrides <> ''").select("site_id", o).select("site_id", F.substring_index("o", "=", 1).alias("key"), (F.substring_index("o", "=", -1) == "true").alias("on"))
    given = given.join(F.broadcast(keys.withColumn("known", F.lit(True))), "key", "left")
    per = given.groupBy("site_id").agg(
        F.bool_or(F.col("known").isNull()).alias("bad"),
        *[F.bool_or(F.when(F.col("key") == d, F.col("on"))).alias(f"set_{d}") for d in DIMENSIONS],
        *[F.coalesce(F.bool_or((F.col("dimension") == d) & (F.col("key") != d) & F.col("on")), F.lit(False)).alias(f"by_{d}") for d in DIMENSIONS],
        F.sort_array(F.collect_set(F.when(F.col("on") & ~F.col("key").isin(*DIMENSIONS), F.col("key")))).alias("plus"), F.collect_set(F.when(~F.col("on"), F.col("key"))).alias("minus"),
    )
    rows = requests.join(F.broadcast(presets), "preset", "left").join(per, "site_id", "left")
    none = F.array().cast("array<string>")
    families = F.filter(F.split("families", " "), lambda f: f != "")
    families = F.array_except(F.array_union(families, F.coalesce("plus", none)), F.coalesce("minus", none))
    return rows.select(
        "site_id", "preset", (F.col("protocols").isNotNull() & ~F.coalesce("bad", F.lit(False))).alias("valid"),
        *[F.coalesce(F.col(f"set_{d}"), F.col(d) | F.coalesce(F.col(f"by_{d}"), F.lit(False))).alias(d) for d in DIMENSIONS], F.array_join(F.sort_array(families), " ").alias("families"),
    )


def probe_scopes(probes: DataFrame) -> DataFrame:
    """For each of the eight combinations of dimensions, how many probes of each category are in."""
    yes = F.array(F.lit(False), F.lit(True))
    rows = probes
    for d in ("protocols", "account_auth", "commerce"):
        rows = rows.withColumn(d, F.explode(yes))
    included = (F.col("scope") == "core") | ((F.col("scope") == "protocols") & F.col("protocols")) | ((F.col("scope") == "account_auth") & F.col("account_auth")) | ((F.col("scope") == "commerce") & F.col("commerce"))
    return rows.groupBy("protocols", "account_auth", "commerce", "category").agg(F.count_if(included).alias("included"), F.count("*").alias("all_probes"))


def readiness_cube(scopes: DataFrame, passes: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes asked for and passed over all combinations of a scope's three flags and the probes' category, with all their totals, as one plan of grouping sets.

    ``level`` is the grouping id: a bit for each of protocols, account_auth, commerce and category that the row is a total over. Probes are a fixed dimension; a site
    without a passed probe counts with none.
    """
    rows = scopes.join(F.broadcast(probes)).join(passes.distinct().withColumn("hit", F.lit(True)), ["site_id", "ordinal"], "left")
    inside = (F.col("scope") == "core") | ((F.col("scope") == "protocols") & F.col("protocols")) | ((F.col("scope") == "account_auth") & F.col("account_auth")) | ((F.col("scope") == "commerce") & F.col("commerce"))
    rows = rows.where(inside).select("protocols", "account_auth", "commerce", "category", F.coalesce("hit", F.lit(False)).cast("int").alias("hit"))
    out = rows.cube("protocols", "account_auth", "commerce", "category").agg(F.grouping_id().alias("level"), F.count("*").alias("asked"), F.sum("hit").alias("passed"))
    return out.withColumn("percent", F.bround(F.col("passed") / F.col("asked") * 100, 0).cast("long"))
