"""Peer snapshots as JSON: an envelope with a version, a date and profiles, read with a fixed schema and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
CHECK = "struct<score: bigint, max: bigint, state: string, evidence_level: string>"
PROFILE = f"struct<name: string, category: string, `group`: string, size: string, url: string, essentials_checks: map<string, {CHECK}>, agent_passed: array<string>>"
SCHEMA = f"schema_version bigint, snapshot_date date, profiles array<{PROFILE}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per profile and check, with the labels of the probes the profile passed; a file of another version, or a bare list, is refused when it is read."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    version = F.coalesce("schema_version", F.lit(-1))
    rows = rows.select("snapshot_date", F.explode(F.when(version == VERSION, F.col("profiles")).otherwise(F.raise_error(F.concat(F.lit("snapshot version "), version.cast("string"))))).alias("p"))
    checks = rows.select("snapshot_date", "p.name", "p.category", F.col("p.group").alias("grp"), "p.size", "p.url", "p.agent_passed", F.explode("p.essentials_checks").alias("check_name", "c"))
    return checks.select(
        "snapshot_date", "name", "category", "grp", "size", "url", "check_name", "c.score", "c.max", "c.state", F.col("c.evidence_level").alias("evidence"), F.size("agent_passed").cast("long").alias("probes_passed"), "agent_passed"
    )


def write(rows: DataFrame, path: str, day: str) -> None:
    """Rows as read() gives them as one envelope; what read() gives of it are the same rows. A snapshot is a bounded list of peers.

    Without a category it is the group, without url or labels these are empty.
    """
    for name, other in (("category", F.col("grp")), ("url", F.lit("")), ("agent_passed", F.array().cast("array<string>"))):
        if name not in rows.columns:
            rows = rows.withColumn(name, other)
    check = F.struct("score", "max", "state", F.col("evidence").alias("evidence_level"))
    profiles = rows.groupBy("name", "category", "grp", "size", "url", "agent_passed").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("check_name", check.alias("c"))))).alias("essentials_checks"))
    profile = F.struct("name", "category", F.col("grp").alias("group"), "size", "url", "essentials_checks", "agent_passed")
    one = profiles.agg(F.collect_list(profile).alias("profiles"))
    one.select(F.lit(VERSION).alias("schema_version"), F.lit(day).alias("snapshot_date"), "profiles").coalesce(1).write.mode("overwrite").json(path)
