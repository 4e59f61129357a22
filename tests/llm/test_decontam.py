import random

from sitegauge.llm.common import prepare
from sitegauge.llm.decontam import Matcher, budget, distances, drop_leaky, fold, item_blocks, leaks


def plain_ends(pattern, text, most):
    row = list(range(len(pattern) + 1))
    out = []
    for j, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        if row[-1] <= most:
            out.append((j, row[-1]))
    return out


def test_distance():
    rng = random.Random(1)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(lo, 40))) for lo in (1, 0))
        assert list(distances(p, t, 9)) == plain_ends(p, t, 9)


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + "q" + text[i:], text[:i] + text[i + 1 :], text[:i] + "q" + text[i + 1 :]])
    return text


def make(rng):
    items = [(i, " ".join(rng.choice("lorem ipsum dolor sit amet Élan tempor".split()) for _ in range(rng.randrange(6, 30)))) for i in range(8)]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choice("alpha beta dolor sit gamma".split()) for _ in range(rng.randrange(30))) for _ in range(2)]
        i, t = rng.choice(items)
        texts.append(f"{parts[0]} {edited(rng, t, rng.randrange(2 * budget(t) + 1)).upper()} {parts[1]}" if rng.random() < 0.7 else parts[0])
    return items, texts


def test_search_against_plain():
    items, texts = make(random.Random(2))
    matcher = Matcher(items, least=10)
    hits = 0
    for text in texts:
        found = matcher.find(text)
        want = {i for i, t in items if plain_ends(fold(t), fold(text), budget(t))}
        assert {i for i, *_ in found} == want
        hits += len(want)
        for i, a, b, d in found:
            assert min(x for x in plain_ends(fold(dict(items)[i]), fold(text)[a:b], 99) if x[0] == b - a)[1] == d
    assert hits > 10


def test_operator(spark):
    prepare(spark)
    items, texts = make(random.Random(3))
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, items[0][1], 1), (98, None, 1), (99, "", 1), (97, "x " * 50000 + items[1][1], 1), (97, "x " * 50000 + items[1][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (50, None), (None, "some text that stands nowhere at all"), (51, ""), (52, "a")], "item_id long, text string")
    matcher = Matcher(items)
    got = sorted(map(tuple, leaks(docs, bench).collect()), key=str)
    assert got == sorted(((i, *m) for i, t, _ in rows for m in matcher.find(t or "")), key=str)
    kept = drop_leaky(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not matcher.find(t or "") for _, t, _ in rows)
    assert leaks(docs.limit(0), bench).count() == leaks(docs, bench.limit(0)).count() == 0


def test_short_and_unnamed_items(spark):
    """Items under 25 characters are met as whole words without edits; an item without an id is an item."""
    prepare(spark)
    texts = ["The answer is  Forty Two.", "forty twofold", "xforty two", "so forty too", "Forty\ttwo forty two", "an item without any name of its own, yet", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "forty two"), (2, " "), (3, ""), (None, "An item without any name of its own")], "item_id long, text string")
    got = sorted(map(tuple, leaks(docs, bench).collect()), key=str)
    assert got == [(0, 1, 15, 24, 0), (4, 1, 0, 9, 0), (4, 1, 10, 19, 0), (5, None, 0, 35, 0)]
    assert sorted(r.doc_id for r in drop_leaky(docs, bench).collect()) == [1, 2, 3, 6]


def test_fold_by_character():
    import unicodedata

    for c in map(chr, [*range(0x3100), 0x1E9E, 0x10400]):
        assert len(fold(c)) == 1 and (c.isspace() <= (fold(c) == " "))
        for around in ("", "İ", "Σ", "a", "ς"):
            assert fold(around + c + around) == fold(around) + fold(c) + fold(around), (c, around)
        if not c.isspace() and c not in "İςΣ":
            assert fold(c) == c.lower()
    assert fold("ΟΔΟΣ ΟΔΟΣ") == fold("οδος οδοσ") == fold("ΟΔΟΣ οδος") and unicodedata.name(fold("Σ")).endswith("SIGMA")


def test_item_blocks_are_bounded(spark):
    rows = [(i, f"item {i} " * 20) for i in range(200)] + [(None, "x" * 5000), (1, None), (3, "item 3 " * 20)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    blocks = list(item_blocks(bench, 4000))
    assert all(len(b) == 1 or sum(len(t) for _, t in b) <= 8000 for b in blocks)
    assert sorted((x for b in blocks for x in b), key=str) == sorted({(i, t) for i, t in rows if t}, key=str)
    assert list(item_blocks(bench.limit(0))) == [[]]
