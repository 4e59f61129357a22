import random
import re

import numpy as np
import xxhash

from sitegauge.llm import simhash
from sitegauge.llm.common import prepare
from sitegauge.llm.components import components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, most=3):
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def family(rng, n):
    out = []
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            out.append(x)
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
    return out


def components_of(spark, fps):
    df = spark.createDataFrame([(simhash._signed(x),) for x in set(fps)], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    return {x: roots.get(simhash._signed(x), simhash._signed(x)) for x in set(fps)}


def same(fps, found):
    want = brute(fps)
    return len({(w, found[x]) for w, x in zip(want, fps)}) == len(set(want)) == len(set(found.values()))


def test_index(spark, monkeypatch):
    rng = random.Random(7)
    fps = list(dict.fromkeys(family(rng, 40)))
    assert same(fps, components_of(spark, fps))
    monkeypatch.setattr(simhash, "NODE_MEMBERS", 8)  # nodes split many times over
    base = rng.getrandbits(64)
    fps = list(dict.fromkeys(fps + [base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for _ in range(60)]))
    assert same(fps, components_of(spark, fps))


def test_documents(spark):
    prepare(spark)
    rng = random.Random(3)
    texts = [None, "", "one", "One two", "ONE  two", "a b c", "É b c"]
    for _ in range(15):
        words = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(3, 200))]
        texts.append(" ".join(words))
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "z"
            texts += ["\n".join(words)] * 2
    rows = [(i + 10, t, 1) for i, t in enumerate(texts)] + [(None, "a b c", 1), (12, "one", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    want = brute([plain(t) for _, t, _ in rows])
    least = {}
    for w, (i, _, _) in zip(want, rows):
        if i is not None:
            least[w] = min(i, least.get(w, i))
    assert sorted(((i, f"{plain(t):016x}", least[w]) for w, (i, t, _) in zip(want, rows)), key=str) == sorted(map(tuple, got), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for w, (i, _, _) in zip(want, rows) if i == least[w])


def test_components(spark):
    rng = random.Random(4)
    n, edges = 300, [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)]
    edges += [(rng.randrange(180, 300), rng.randrange(180, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    group = list(range(n))
    for _ in range(n):
        for a, b in edges:
            if a is not None:
                group[a] = group[b] = min(group[a], group[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(group[k] == v for k, v in got.items())
    assert set(got) == {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert np.array_equal(sorted(got), sorted(set(got)))


def test_keep_one_loses_no_text(spark):
    """Ids that stand for several texts, rows without an id, repeated rows."""
    prepare(spark)
    rng = random.Random(9)
    a, b, c, d = (" ".join(rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(60)) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (7, c), (None, d), (None, d), (None, c), (8, None), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, count int")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(3, a), (5, b), (7, c), (None, d), (8, None), (8, None)], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.keep_one(docs).columns == docs.columns
