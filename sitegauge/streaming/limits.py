"""Admission and freshness over events, as batch and as Structured Streaming."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.runtime import shared_dir
from sitegauge.sources.stored import StoredTable

PER_WINDOW, WINDOW = 3, "1 minute"


def admissions(events: DataFrame, most: int = PER_WINDOW) -> DataFrame:
    """Requests of each client and fixed minute that are admitted (the first ``most``) and rejected.

    Counts alone decide, so nothing is ranked and the sum is taken before the shuffle. Works on a stream too.
    """
    seen = events.groupBy(F.window("ts", WINDOW).alias("w"), F.col("user_id").alias("client")).agg(F.count("*").alias("n"))
    return seen.select("client", F.col("w.start").alias("minute"), F.least("n", F.lit(most)).cast("long").alias("admitted"), F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("rejected"))


def stream_admissions(events: DataFrame, late: str = "10 minutes", most: int = PER_WINDOW) -> DataFrame:
    """admissions() over a stream; a minute is final once the watermark has passed it."""
    return admissions(events.withWatermark("ts", late), most)


def admitted_rows(events: DataFrame, most: int = PER_WINDOW) -> DataFrame:
    """The admitted requests themselves, by time and then event_id."""
    w = Window.partitionBy("user_id", F.window("ts", WINDOW)).orderBy("ts", "event_id")
    return events.withColumn("k", F.row_number().over(w).cast("long")).where(F.col("k") <= most).select("event_id", "user_id", "k")


def latest(events: DataFrame) -> DataFrame:
    """An upsert by (user_id, event_type): the last event wins."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return events.groupBy("user_id", "event_type").agg(last.alias("x"), F.count("*").alias("writes")).select("user_id", "event_type", "x.event_id", F.round("x.value", 6).alias("value"), "writes")


def stored(events: DataFrame) -> DataFrame:
    """latest() by merges into a stored table in the shared folder, one for the events of even number and one for the others; the table's rows."""
    spark = events.sparkSession
    table = StoredTable(spark, f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}", "user_id long, event_type string, ts timestamp, event_id long, value double", ["user_id", "event_type"], ["ts", "event_id"])
    rows = events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    for odd in (0, 1):
        table.merge(rows.where(F.pmod("event_id", F.lit(2)) == odd))
    return table.read().select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def fresh_lookups(events: DataFrame, days: int = 30) -> DataFrame:
    """Lookups of each event_type that its cache answers: each (user_id, event_type) is written by a lookup that finds no entry younger than ``days``,
    and a hit leaves the entry as it is; an entry of just that age is none.

    Rows without a time say nothing. The state of a key is its last write, so a sorted pass over each partition holds one number a key, however many lookups it has.
    """
    ttl = days * 86_400_000_000

    def run(batches):
        key, written = None, 0
        for batch in batches:
            hits = []
            for k in zip(*(c.to_pylist() for c in batch.columns)):
                if k[:2] == key and k[2] - written < ttl:
                    hits.append(True)
                else:
                    key, written = k[:2], k[2]
                    hits.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(hits, pa.bool_())], names=["event_type", "hit"])

    kind = events.schema["event_type"].dataType.simpleString()
    rows = events.where("ts is not null").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    rows = rows.repartition("user_id", "event_type").sortWithinPartitions("user_id", "event_type", "at", "event_id").select("user_id", "event_type", "at")
    return rows.mapInArrow(run, f"event_type {kind}, hit boolean").groupBy("event_type").agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"))
