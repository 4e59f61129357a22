"""Connected components of a link table, distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.runtime import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (src, dst: long); root is the least node reachable.

    Alternating large-star and small-star steps: every node hands its neighbours its least neighbour, so the
    number of links never grows and the rounds grow with the logarithm of the longest chain. Every
    round ends in a reliable checkpoint; a hub's links are summed before the shuffle, and its join can be split.
    Links with a null end and self-links say nothing; no links give no rows.
    """
    edges = links.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct()
    edges, before = cut(edges), None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select("hi", "lo", "m")
        moved = small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut(moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking items a[i] and b[i]; a label is the least index of its component."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return labels
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped
