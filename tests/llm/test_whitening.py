import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from sitegauge.llm import queries, whitening
from sitegauge.llm.common import prepare

DATA = Path("/root/testdata/sf0.001")
KIND = "vec_id long, embedding array<float>"


def plain(rows, components=4, d=None):
    """The contract, on one place: exact sums in whole numbers, numpy for the rest. Rows (id, components, n, deviation, whitened up to sign, explained)."""
    whole = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = d or len(whole[0][1])
    whole = [(i, x) for i, x in whole if len(x) == d]
    fit = sorted({x for _, x in whole})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array([s / n for s in total])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    out = []
    for i, x in whole:
        w = (np.array(x, float) - np.array([s / n for s in total])) @ v / np.sqrt(e)
        out.append((i, n, sum((n * c - s) ** 2 for c, s in zip(x, total, strict=True)), w, e / np.trace(centred.T @ centred / n)))
    return out


def same(got, rows, components=4, d=None):
    want = plain(rows, components, d)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len(got) == components * len(want)
    signs = None
    for i, n, deviation, w, explained in want:
        own = sorted(by[i, deviation], key=lambda r: r.component)[:: len(by[i, deviation]) // components]
        assert [r.component for r in own] == list(range(1, components + 1)) and {r.n for r in own} == {n}
        signs = signs if signs is not None else [1 if abs(r.whitened - a) < abs(r.whitened + a) else -1 for r, a in zip(own, w, strict=True)]
        assert all(abs(r.whitened - s * a) < 1e-8 for r, s, a in zip(own, signs, w, strict=True))
        assert all(abs(r.explained - x) < 1e-10 for r, x in zip(own, explained, strict=True))
    assert {r.identity_error for r in got}.pop() < 1e-9 and len({r.identity_error for r in got}) == 1


def test_against_definition(spark, monkeypatch):
    """Several tiles and row-blocks, a vector that is a third of all rows, a large mean, nulls, other lengths, clashing names."""
    prepare(spark)
    monkeypatch.setattr(whitening, "TILE", 4)
    monkeypatch.setattr(whitening, "ROWS", 16)
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(10, 10)) * np.arange(1, 11)
    rows = [(i, (rng.normal(size=10) @ mix + 500).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(None, rows[8][1]), (3, rows[3][1]), (5, [7.0 * k for k in range(10)])]
    odd = [(2000, None), (2001, []), (2002, [1.0] * 9), (2003, [1.0] * 9 + [None]), (2004, [1.0] * 9 + [math.nan]), (2005, [math.inf] * 10), (2006, [3e38] * 10), (2007, [1.0] * 11)]
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame([(i, v, 1, "y") for i, v in rows + odd], KIND + ", x int, n string")
    same(whitening.whiten(frame).collect(), rows)


def test_doubles_and_few_dimensions(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    rows = [(i, np.round(rng.normal(size=2) * [9, 1], 3).astype(np.float32).tolist()) for i in range(40)]
    same(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows, 2)


def test_no_direction(spark):
    """One distinct vector, a component without variance, and no row at all."""
    prepare(spark)
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], KIND)).collect()
    assert sorted(tuple(r) for r in one) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [2.0, 3.0, 0.0])], KIND)).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.deviation == 2 * 256**2 for r in flat) and abs(flat[0].explained - 1) < 1e-12 and flat[0].identity_error < 1e-9
    for none in ([], [(1, None), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(none, KIND)).count() == 0


def test_beyond_long(spark):
    """A sum beyond a long: exact where it fits, else null."""
    prepare(spark)
    got = whitening.whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>"), 1).collect()
    assert all(r.deviation is None and r.n == 3 for r in got) and len(got) == 3


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
def test_registered_query(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{DATA}/embeddings.parquet'").fetchall()
    got = queries.op11_embedding_whitening(spark, str(DATA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(got.collect(), rows)
