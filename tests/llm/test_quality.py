import random
import re

from sitegauge.llm.common import prepare
from sitegauge.llm.quality import clean, judge, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    repeats = len(marked)
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeats,
        len(words) < 50 or 100 * repeats > 50 * len(words),
    )


def test_counts_against_plain():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b c", "é", "x|y", "\n", " ", "\t", " ", "\x0b", "a b c\n", "#", "\x1c"]) for _ in range(rng.randrange(120)))
        assert judge(text)[:6] == plain(text)


def test_lines():
    good = "This is a usual line of text that ends well.\n" + " ".join(f"word{i}" for i in range(60)) + "."
    assert judge(good)[6] and clean(good) == good
    menu = "\n".join("Home | About | Contact | News" for _ in range(3))
    assert clean(good + "\n" + menu) == good and judge(good + "\n" + menu)[6]
    bad = " ".join(f"w{i}***" for i in range(80))
    assert not judge(bad)[6] and not judge(" ".join(f"W{i}!!" for i in range(80)))[6]
    assert clean(good + "\nAll rights reserved.") == good


def test_operator(spark):
    prepare(spark)
    rows = [(1, None, 1), (2, "", 1), (None, "w " * 60, 1), (3, "x y z. " * 9, 1), (3, "x y z. " * 9, 1), (4, " ".join(f"v{i}" for i in range(30000)), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in quality_rules(df, with_text=True).collect()}
    assert quality_rules(df).count() == 6 and quality_rules(df.limit(0)).count() == 0
    assert got[1].base_failed and got[2].n_words == 0 and not got[3].kept and got[4].kept and got[4].n_words == 30000
