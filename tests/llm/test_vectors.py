import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.llm import queries, vectors
from sitegauge.llm.common import prepare

DATA = Path("/root/testdata/sf0.001")
KIND = "vec_id long, embedding array<float>"


def brute(rows, asked, k=10):
    """For each asked id its k nearest rows: {id: [(distance, id)]}."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i in sorted(set(ids[asked(ids)].tolist())):
        y = x[np.flatnonzero(ids == i)[0]]
        apart = np.sqrt(((x - y) ** 2).sum(axis=1))
        out[i] = sorted({(d, j) for d, j in zip(apart.tolist(), ids.tolist(), strict=True) if j != i})[:k]
    return out


def by_query(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    assert set(got) == {i for i, near in want.items() if near}
    assert all(len(near) == len(want[i]) and sorted(near) == near for i, near in got.items())
    return np.mean([len({j for _, j in got[i]} & {j for _, j in near}) / len(near) for i, near in want.items() if near])


def test_recall_with_clusters(spark, monkeypatch):
    """A third of all rows around one vector, exact copies, plain noise; lists over several blocks and queries over several chunks."""
    prepare(spark)
    monkeypatch.setattr(vectors, "BLOCK", 150)
    monkeypatch.setattr(vectors, "SAMPLE", 1500)
    rng = np.random.default_rng(4)
    noise, hot, copy = rng.normal(size=(1500, 24)), rng.normal(size=24) + 0.02 * rng.normal(size=(1000, 24)), np.tile(rng.normal(size=24), (500, 1))
    x = np.concatenate([noise, hot, copy]).astype(np.float32)
    ids = rng.permutation(len(x))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    got = by_query(vectors.search(spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], KIND + ", list int, score double"), F.col("vec_id") % 10 == 0).collect())
    want = brute(rows, lambda i: i % 10 == 0)
    assert recall(got, want) >= 0.93
    exact = {(i, j): d for i, near in want.items() for d, j in near}
    assert all(abs(d - exact[i, j]) < 1e-12 for i, near in got.items() for d, j in near if (i, j) in exact)
    copies = set(ids[2500:].tolist())
    for i in copies:  # ties: the least ids
        if i % 10 == 0:
            assert got[i] == [(0.0, j) for j in sorted(copies - {i})[:10]]


def test_edges(spark):
    """Rows that take no part, repeated rows, an id with two vectors, few candidates, none, an empty table."""
    prepare(spark)
    good = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.5, 0.0]), (2, [0.0, 1.0, 0.0]), (100, [0.5, 0.5, 0.0]), (-100, [0.0, 0.0, 2.0])]
    bad = [(None, [1.0, 0.0, 0.0]), (200, None), (300, [0.0, 0.0, 0.0]), (400, [math.nan, 1.0, 1.0]), (5, [math.inf, 1.0, 1.0]), (600, [1.0, None, 0.0]), (700, [1.0, 2.0]), (800, [])]
    frame = spark.createDataFrame(good + bad + [good[1]] * 30 + [good[0]], KIND)
    assert by_query(vectors.search(frame, F.col("vec_id") % 100 == 0).collect()) == brute(good, lambda i: i % 100 == 0)
    two = by_query(vectors.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [2.0, 0.0])], KIND), F.col("vec_id") == 0).collect())
    assert two == {0: [(1.0, 1), (1.0, 1)]}
    assert vectors.search(spark.createDataFrame(good[:1], KIND), F.col("vec_id") == 0).count() == 0
    assert vectors.search(spark.createDataFrame(good, KIND), F.lit(None).cast("boolean")).count() == 0
    assert vectors.search(spark.createDataFrame([], KIND), F.col("vec_id") == 0).count() == 0


def test_same_rows_whatever_the_split(spark):
    prepare(spark)
    rng = np.random.default_rng(9)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))], KIND)
    once, again = (vectors.search(f, F.col("vec_id") % 20 == 0, 5) for f in (frame.repartition(1), frame.repartition(7)))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
def test_registered_query(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{DATA}/embeddings.parquet'").fetchall()
    got = queries.op12_nearest_neighbours(spark, str(DATA))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert recall(by_query(got.collect()), brute(rows, lambda i: i % 100 == 0)) >= 0.9
