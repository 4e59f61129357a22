"""Merges into a stored table: latest row by key, parts, versions, crashes and repeats."""

import random

import pytest

from sitegauge.sources.stored import StoredTable

SCHEMA = "user long, kind string, at long, value double"


def table(spark, path):
    return StoredTable(spark, str(path), SCHEMA, ["user", "kind"], ["at"], 4)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_batches(spark, tmp_path):
    """Random batches, each merged twice, against a dictionary."""
    rng = random.Random(5)
    t, want = table(spark, tmp_path / "t"), {}
    assert t.version() == 0 and rows(t.read()) == []
    for k in range(4):
        batch = [(rng.choice([1, 2, 3, 4, 5, None]), rng.choice("ab"), rng.randrange(6), float(rng.randrange(9))) for _ in range(25)]
        for user, kind, at, value in batch:
            want[user, kind] = max(want.get((user, kind), (-1, 0.0)), (at, value))
        frame = spark.createDataFrame([(*b, "extra") for b in batch], SCHEMA + ", note string")
        assert t.merge(frame) == 2 * k + 1 and t.merge(frame) == 2 * k + 2
        assert rows(t.read()) == sorted(((*key, *v) for key, v in want.items()), key=str) == rows(table(spark, tmp_path / "t").read())
    assert t.merge(spark.createDataFrame([], SCHEMA)) == 8
    assert len(rows(t.read(2))) <= len(rows(t.read()))  # older versions stay


def test_only_touched_parts_are_written(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.merge(spark.createDataFrame([(u, "a", 1, 0.0) for u in range(40)], SCHEMA))
    before = t._folders(1)
    t.merge(spark.createDataFrame([(7, "a", 2, 1.0)], SCHEMA))
    after = t._folders(2)
    assert len(before) == len(after) == 4 and sum(before[p] != after[p] for p in before) == 1
    assert rows(t.read().where("user = 7")) == [(7, "a", 2, 1.0)] and t.read().count() == 40


def test_crash_before_the_swap(spark, tmp_path):
    """Parts are written, the process dies before the rename: readers see the old rows, and the merge can run again."""
    t = table(spark, tmp_path / "t")
    t.merge(spark.createDataFrame([(1, "a", 1, 0.0)], SCHEMA))
    batch = spark.createDataFrame([(1, "a", 2, 5.0), (2, "a", 1, 1.0)], SCHEMA)
    t.write(batch, t.version(), "data/lost")
    assert t.version() == 1 and rows(t.read()) == [(1, "a", 1, 0.0)]
    assert t.merge(batch) == 2 and rows(t.read()) == [(1, "a", 2, 5.0), (2, "a", 1, 1.0)]


def test_two_merges_at_once(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.merge(spark.createDataFrame([(1, "a", 1, 0.0)], SCHEMA))
    folders = t._folders(1)
    assert t.publish(1, folders) == 2
    with pytest.raises(RuntimeError, match="version 2"):
        t.publish(1, folders)
    assert not [f for f in (tmp_path / "t/versions").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]
