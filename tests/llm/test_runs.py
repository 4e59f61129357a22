import hashlib
import random
import zlib
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest

from sitegauge.llm import queries, runs
from sitegauge.llm.common import prepare

DATA = Path("/root/testdata/sf0.001")
KIND = "doc_id long, text string"


def plain(words, least=24):
    """All runs by their definition: for each period the maximal stretches, where no smaller period has the same one."""
    out = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def kept(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def contract(doc_id, text):
    words = (text or "").encode().split()
    words, n = [w.decode() for w in words], len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain(words)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in found), kept(words, found))]
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, *digest)


def test_runs_against_definition():
    """Random words over few letters, Fibonacci and Thue-Morse words, powers with errors; many sequences at once."""
    rng = random.Random(5)
    fib, tm = "ab", "a"
    for _ in range(10):
        fib, tm = fib + fib[: len(fib) * 5 // 8], tm + tm.translate(str.maketrans("ab", "ba"))
    cases = [list(fib[:300]), list(tm[:300]), ["x"] * 200, [], ["a"], list("ab" * 60 + "c" + "ab" * 60)]
    for _ in range(300):
        root = [rng.choice("abc") for _ in range(rng.randrange(1, 12))]
        body = [rng.choice("ab") for _ in range(rng.randrange(0, 40))] + root * rng.randrange(1, 9) + [rng.choice("abc") for _ in range(rng.randrange(0, 30))]
        if rng.random() < 0.4 and body:
            body[rng.randrange(len(body))] = "z"
        cases.append(body * rng.choice([1, 1, 2, 3, 4]))
    for least in (2, 8, 24):
        bounds = np.cumsum([0, *map(len, cases)])
        words = np.array([ord(c) - 97 for body in cases for c in body], np.int64)
        got = runs.runs(words, bounds, least)
        assert [[tuple(r[1:].tolist()) for r in got if r[0] == k] for k in range(len(cases))] == [plain(c, least) for c in cases]


def test_documents(spark):
    """Runs in the middle of other words, nested runs, tabs and long spaces, words beyond ASCII, null and empty texts, null and repeated ids."""
    prepare(spark)
    rng = random.Random(6)
    rows = [(None, "a b c " * 12), (None, None), (1, ""), (1, " \n\t "), (2, "é ü x " * 20), (3, "x" * 50_000)]
    for i in range(10, 200):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(300))]
        for _ in range(rng.randrange(4)):
            at, root = rng.randrange(len(words) + 1), [f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 30))]
            words[at:at] = (root * rng.randrange(2, 9))[: rng.randrange(1, 200)]
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += rows[-3:]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], KIND + ", runs int, a int")
    found = runs.periodic_runs(docs).collect()
    as_text = lambda i, t: [w.decode() for w in (t or "").encode().split()]
    want = [(i, plain(as_text(i, t)), kept(as_text(i, t), plain(as_text(i, t)))) for i, t in rows]
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=str) == sorted(want, key=str)
    short = runs.periodic_runs(docs.limit(80), 7).collect()
    assert all([tuple(x) for x in r.runs] == plain(as_text(r.doc_id, t), 7) for r, (_, t) in zip(short, rows[:80], strict=True))
    got = runs.digests(runs.periodic_runs(runs.with_periodic_tail(docs))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((contract(i, t) for i, t in rows), key=str)
    assert sum(r.n_runs > 0 for r in got) > 50


def test_long_texts(spark):
    """One word 400,000 times, and a run at the far end of a text over one step."""
    prepare(spark)
    rng = random.Random(7)
    noise = [f"w{rng.randrange(10**6)}" for _ in range(400_000)]
    docs = spark.createDataFrame([(1, "x " * 400_000), (2, " ".join(noise + ["a", "b", "c"] * 30))], KIND)
    got = {r.doc_id: r for r in runs.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 400_000, 1)] and got[1].collapsed == "x"
    assert [tuple(r) for r in got[2].runs] == [(400_000, 90, 3)] and got[2].collapsed == " ".join([*noise, "a", "b", "c"])


def test_empty_table(spark):
    assert runs.digests(runs.periodic_runs(runs.with_periodic_tail(spark.createDataFrame([], KIND)))).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
def test_registered_query(spark):
    """The whole query over the smallest table against the definition."""
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    got = queries.op13_periodic_runs(spark, str(DATA))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(contract(i, t) for i, t in rows)
