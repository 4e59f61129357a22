"""Time-to-live hits of a stream are those of the batch, over late rows, several batches and a restart."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sitegauge.streaming.limits import fresh_lookups
from sitegauge.streaming.ttl import stream_lookups

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"
START = datetime.datetime(2024, 1, 1)


def at(days):
    return START + datetime.timedelta(days=days)


def plain(rows, days=30):
    out, written = {}, {}
    for event, ts, user, kind in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
        hit = (user, kind) in written and ts - written[user, kind] < datetime.timedelta(days=days)
        if not hit:
            written[user, kind] = ts
        out[event] = hit
    return out


def run(spark, folder, where, until=None):
    """Reads what lies in the folder, a file a batch, from the checkpoint; the rows so far."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in/*"))
    query = stream_lookups(stream).writeStream.format("parquet").option("path", str(where)).option("checkpointLocation", str(folder / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
        assert query.exception() is None
    finally:
        query.stop()
    return {r.event_id: r.hit for r in spark.read.schema("event_id long, hit boolean").parquet(str(where)).collect()}


def put(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / "in" / name))


def test_stream_is_the_batch(spark, tmp_path):
    """Rows within the watermark's lateness come in any order; the query is stopped after each file and goes on from its checkpoint."""
    rng = random.Random(3)
    rows = [(k, at(rng.random() * 100), k % 3, "ab"[k % 2]) for k in range(80)]
    # an exact age of 30 days is no hit, nor is one after a hit that did not renew
    rows += [(200, at(0), 9, "x"), (201, at(20), 9, "x"), (202, at(30), 9, "x"), (203, at(59.99), 9, "x"), (204, at(60), 9, "x"), (205, None, 9, "x"), (206, at(60), 9, "x")]
    timed = sorted((r for r in rows if r[1]), key=lambda r: r[1])
    parts = [timed[:30], timed[30:60], [*timed[60:], rows[-2]]]
    # a row that comes in the next file, but not later than the watermark allows
    late = parts[0][-1]
    parts[0].remove(late)
    parts[1].append(late)
    parts[1] = [r for r in parts[1] if r[1] <= late[1] + datetime.timedelta(minutes=9)] + [r for r in parts[1] if r[1] > late[1] + datetime.timedelta(minutes=9)]
    got = {}
    for k, part in enumerate(parts):
        rng.shuffle(part)
        put(spark, part, tmp_path, f"f{k}")
        got = run(spark, tmp_path, tmp_path / "out")
    put(spark, [(999, at(400), 77, "end")], tmp_path, "f9")
    got = run(spark, tmp_path, tmp_path / "out")
    want = plain(rows)
    assert got == want | ({999: False} if 999 in got else {})
    assert [want[k] for k in (200, 201, 202, 203, 204, 206)] == [False, True, False, True, False, True]
    batch = {r.event_type: (r.lookups, r.hits) for r in fresh_lookups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert batch == {t: (sum(1 for r in rows if r[1] and r[3] == t), sum(want[r[0]] for r in rows if r[1] and r[3] == t)) for t in "abx"}


def test_too_late_is_dropped(spark, tmp_path):
    put(spark, [(1, at(0), 1, "a"), (2, at(50), 1, "a")], tmp_path, "f0")
    run(spark, tmp_path, tmp_path / "out")
    put(spark, [(3, at(10), 1, "a"), (4, at(51), 1, "a")], tmp_path, "f1")
    run(spark, tmp_path, tmp_path / "out")
    put(spark, [(5, at(99), 2, "a")], tmp_path, "f2")
    got = run(spark, tmp_path, tmp_path / "out")
    assert 3 not in got and (got[1], got[2], got[4]) == (False, False, True)
