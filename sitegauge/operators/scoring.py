"""Scores of sites from check rows (site_id, check_name, score, state, evidence, effort).

Rows of checks that the rubric does not have, or without a name, are left out by the join with it; null points count for nothing in sums. Repeated rows count each. A site without
rows has no row, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
EFFORT = {"low": 1, "medium": 2, "high": 3}
SEVERITY = {"fail": 0, "partial": 1, "warn": 2}


def _map(values: dict, key: str, other: int):
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col(key) == k, v).otherwise(out)
    return out


def with_rubric(rows: DataFrame, rubric: DataFrame) -> DataFrame:
    """Check rows with pillar and most points; the rubric has 13 rows, and so is broadcast."""
    return rows.join(F.broadcast(rubric), "check_name")


def pillar_scores(rows: DataFrame, rubric: DataFrame, caps: DataFrame) -> DataFrame:
    """A row for each site and pillar: points (held to the pillar's cap), and the sum over pillars as overall."""
    sums = with_rubric(rows, rubric).groupBy("site_id", "pillar").agg(F.sum("score").alias("points"))
    capped = sums.join(F.broadcast(caps), "pillar").select("site_id", "pillar", F.least("points", "cap").alias("points"))
    return capped.withColumn("overall", F.sum("points").over(Window.partitionBy("site_id")))


def evidence_score(rows: DataFrame, rubric: DataFrame) -> DataFrame:
    """Half-even percentage of the points of rows that are neither locked nor of unknown evidence."""
    known = with_rubric(rows, rubric).where("state <> 'locked' and evidence <> 'unknown'")
    out = known.groupBy("site_id").agg(F.sum("score").alias("earned"), F.sum("max_score").alias("most"))
    return out.withColumn("percent", F.coalesce(F.bround(F.col("earned") / F.col("most") * 100, 0), F.lit(0)).cast("long"))


def action_order(rows: DataFrame, rubric: DataFrame) -> DataFrame:
    """Checks of each site by missing points per effort, the largest first; ties in the report's own order (ordinal)."""
    gap = (F.col("max_score") - F.col("score")) / _map(EFFORT, "effort", 2)
    w = Window.partitionBy("site_id").orderBy(F.desc("gap"), "ordinal")
    return with_rubric(rows, rubric).withColumn("gap", gap).select("site_id", "check_name", F.round("gap", 6).alias("gap"), F.row_number().over(w).cast("long").alias("place"))


def attention(rows: DataFrame, rubric: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` open checks of each site by severity, then least share of points, then name."""
    open_ = with_rubric(rows, rubric).where(F.col("state").isin(*SEVERITY)).withColumn("severity", _map(SEVERITY, "state", 9))
    ratio = F.when(F.col("max_score") > 0, F.col("score") / F.col("max_score")).otherwise(0.0)
    w = Window.partitionBy("site_id").orderBy("severity", ratio, "check_name")
    evidence = F.when(F.col("evidence").isin("unknown", "not_applicable"), "unavailable").otherwise(F.col("evidence"))
    out = open_.select("site_id", "check_name", "state", evidence.alias("evidence"), "score", "max_score", F.row_number().over(w).cast("long").alias("place"))
    return out.where(F.col("place") <= top)


def check_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("site_id").agg(
        F.count_if(F.col("state") != "locked").alias("included"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("pass", "partial", "fail", "warn", "locked")]
    )


def peer_scores(peers: DataFrame, rubric: DataFrame) -> DataFrame:
    """Points and half-even percentage of every peer (name, grp, size)."""
    out = peers.join(F.broadcast(rubric), "check_name").groupBy("name", "grp", "size").agg(F.sum("score").alias("points"), F.sum("max_score").alias("most"))
    return out.withColumn("percent", F.bround(F.col("points") / F.col("most") * 100, 0).cast("long"))


def histogram(peers: DataFrame, *by: str) -> DataFrame:
    """The peers' percentages (of each group) as one array ``s`` of (percent, upto): how many peers have at most that. At most 101 values, however many peers."""
    counts = peers.groupBy(*by, "percent").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("percent"))
    return counts.select(*by, F.struct("percent", upto.alias("upto")).alias("x")).groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("s"))


def peers_in_all() -> Column:
    return F.element_at("s", -1)["upto"]


def kth(k: Column) -> Column:
    """The percentage of the k-th peer from below, from ``s``."""
    return F.get(F.filter("s", lambda x: x["upto"] >= k), F.lit(0))["percent"]


def standing(percent: Column) -> dict[str, Column]:
    """Inclusive percentile, half-even median and quartiles by index, from ``s``."""
    n = peers_in_all()
    below = F.coalesce(F.array_max(F.transform(F.filter("s", lambda x: x["percent"] <= percent), lambda x: x["upto"])), F.lit(0))
    middle = (kth(F.floor((n + 1) / 2)) + kth(F.floor(n / 2) + 1)) / 2
    return {"percentile": F.bround(below / n * 100, 0).cast("long"), "median": F.bround(middle, 0).cast("long"), "lower_quartile": kth(F.floor(n / 4) + 1), "upper_quartile": kth(F.floor(n * 3 / 4) + 1)}


def position(percent: Column) -> Column:
    return F.when(percent >= F.col("upper_quartile"), "top").when(percent >= F.col("median"), "above middle").when(percent >= F.col("lower_quartile"), "within middle").otherwise("below most")


def against_peers(sites: DataFrame, peers: DataFrame) -> DataFrame:
    """Each site (site_id, percent) among the peers: inclusive percentile, half-even median, quartiles by index, position. The peers become one row of at most 101 counts."""
    both = sites.join(F.broadcast(histogram(peers)))
    own = F.col("percent")
    return both.select("site_id", "percent", *[c.alias(n) for n, c in standing(own).items()]).withColumn("position", position(own))


def first_names(peers: DataFrame, top: int, *by: str) -> DataFrame:
    """The first ``top`` peers by name of every percentage (in each group), as one array ``p``: no other can be among the nearest ``top``."""
    named = peers.withColumn("k", F.row_number().over(Window.partitionBy(*by, "percent").orderBy("name"))).where(F.col("k") <= top)
    return named.groupBy(*by).agg(F.collect_list(F.struct("percent", "name")).alias("p"))


def nearest(percent: Column, top: int) -> Column:
    """From ``p`` the peers nearest to a percentage; ties by the higher percentage, then by name."""
    return F.slice(F.array_sort(F.transform("p", lambda x: F.struct(F.abs(x["percent"] - percent).alias("away"), (-x["percent"]).alias("neg"), x["name"].alias("name")))), 1, top)


def nearest_peers(sites: DataFrame, peers: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` peers nearest to each site's percentage; ties by the higher percentage, then by name."""
    out = sites.join(F.broadcast(first_names(peers, top))).select("site_id", F.posexplode(nearest(F.col("percent"), top)).alias("k", "x"))
    return out.select("site_id", (F.col("k") + 1).cast("long").alias("place"), F.col("x.name").alias("name"), (-F.col("x.neg")).alias("percent"))


def snapshot_faults(rows: DataFrame, rubric: DataFrame) -> DataFrame:
    """Peers whose snapshot rows are not valid, with the number of faults of each kind; valid ones have no row. Every check of the rubric is expected."""
    expected = F.broadcast(rubric.agg(F.count("*").alias("expected")))  # one row
    r = rows.join(F.broadcast(rubric.select("check_name", "max_score")), "check_name", "left").join(expected)
    known = F.col("max_score").isNotNull()
    out = r.groupBy("name").agg(
        F.count_if(~known).alias("unknown_checks"), (F.max("expected") - F.count_if(known)).alias("missing_checks"),
        F.count_if(F.col("max") != F.coalesce("max_score", F.col("max"))).alias("wrong_max"), F.count_if((F.col("score") < 0) | (F.col("score") > F.col("max"))).alias("score_out_of_range"),
        F.count_if(~F.col("state").isin("pass", "partial", "fail", "warn", "locked")).alias("odd_states"), F.count_if(~F.col("evidence").isin("verified", "inferred", "unknown")).alias("odd_evidence"),
    )
    return out.where("unknown_checks + missing_checks + wrong_max + score_out_of_range + odd_states + odd_evidence > 0")


def viewer(rows: DataFrame, rubric: DataFrame) -> DataFrame:
    """Per site and pillar as a reader sees it: points, most, half-up percentage, band, open rows."""
    out = with_rubric(rows, rubric).where("state <> 'locked'").groupBy("site_id", "pillar").agg(F.sum("score").alias("points"), F.sum("max_score").alias("most"), F.count_if(F.col("state") != "pass").alias("open_rows"))
    out = out.withColumn("percent", F.when(F.col("most") > 0, F.floor(F.col("points") * 100 / F.col("most") + 0.5)).otherwise(0).cast("long"))
    return out.withColumn("band", F.when(F.col("percent") >= 85, "Elite").when(F.col("percent") >= 70, "Strong").when(F.col("percent") >= 50, "Developing").otherwise("At risk"))


def viewer_order(rows: DataFrame, rubric: DataFrame) -> DataFrame:
    """Checks of each site by state (fail, partial, warn, locked, pass), then most points, then name."""
    weight = _map({"fail": 0, "partial": 1, "warn": 2, "locked": 3, "pass": 4}, "state", 5)
    w = Window.partitionBy("site_id").orderBy(weight, F.desc("max_score"), "check_name")
    return with_rubric(rows, rubric).select("site_id", "check_name", "state", F.row_number().over(w).cast("long").alias("place"))


def summary(rows: DataFrame, rubric: DataFrame, caps: DataFrame) -> DataFrame:
    """One row per site: overall points, evidence percentage, open rows and the attention list as text."""
    overall = pillar_scores(rows, rubric, caps).groupBy("site_id").agg(F.max("overall").alias("overall"))
    first = attention(rows, rubric).groupBy("site_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "check_name"))), lambda x: x["check_name"]), ",").alias("attention"))
    counts = rows.groupBy("site_id").agg(F.count_if(~F.col("state").isin("pass", "locked")).alias("open_rows"))
    return overall.join(evidence_score(rows, rubric).select("site_id", "percent"), "site_id").join(first, "site_id", "left").join(counts, "site_id")


def viewer_filter(rows: DataFrame, rubric: DataFrame, status: str = "open", text: str = "") -> DataFrame:
    """The checks of each site that a reader asks for: of a status (``open`` is all that is neither passed nor locked, ``all`` any), whose name holds a text; in the viewer's order."""
    state = F.col("state")
    wanted = F.lit(True) if status == "all" else ~state.isin("pass", "locked") if status == "open" else state == status
    kept = rows.where(wanted & F.contains(F.lower("check_name"), F.lit(text.lower())))
    return viewer_order(kept, rubric)


def peer_bars(peers: DataFrame, group: str) -> DataFrame:
    """The peers of a group as bars: share, and width in percent (two at least), by share and name."""
    own = peers.where(F.col("grp") == group).select("name", "percent", F.greatest(F.least("percent", F.lit(100)), F.lit(2)).alias("width"))
    # a peer's place is that within its percentage after all peers of higher ones, of which there are at most 101
    above = own.groupBy("percent").agg(F.count("*").alias("n")).select("percent", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("percent")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    within = F.row_number().over(Window.partitionBy("percent").orderBy("name"))
    return own.withColumn("k", within).join(F.broadcast(above), "percent").select("name", "percent", "width", (F.col("above") + F.col("k")).cast("long").alias("place"))
