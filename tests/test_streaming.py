"""Streams give the batch result once their watermark has passed."""

import pytest
from pyspark.sql import functions as F

from sitegauge.streaming.limits import admissions, stream_admissions


def test_admissions(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{m:02d}:{s:02d}", u) for i, (m, s, u) in enumerate([(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 4, 1), (0, 59, 2), (1, 0, 1), (1, 5, 1), (2, 0, 2)])]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long").select("event_id", F.to_timestamp("t").alias("ts"), "user_id")
    events.coalesce(1).write.parquet(str(tmp_path / "in/a"))
    late = spark.createDataFrame([(99, "2024-01-01 03:00:00", 9)], "event_id long, t string, user_id long").select("event_id", F.to_timestamp("t").alias("ts"), "user_id")
    late.coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = stream_admissions(stream).writeStream.outputMode("append").format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(map(tuple, spark.sql("select * from admitted").collect()))
    want = sorted(map(tuple, admissions(events).collect()))
    assert got == want
    assert {r[0]: (r[2], r[3]) for r in want if r[1].minute == 0} == {1: (3, 1), 2: (1, 0)}


@pytest.mark.parametrize("most", [1, 2])
def test_limit(spark, most):
    events = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "event_id long, user_id long").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:01")))
    row = admissions(events, most).first()
    assert (row.admitted, row.rejected) == (most, 3 - most)
