import random
import zlib

import numpy as np
import pyarrow as pa

from sitegauge.llm.common import prepare, text_buffer
from sitegauge.llm import langid
from sitegauge.llm.langid import identify, keep_identified, presence

WORDS = {"en": "the and of with that there house which".split(), "de": "der und mit das nicht eine häuser straße".split(), "fr": "le les avec être pour élan maison où".split()}


def grams(text, n):
    t = "".join(c.lower() if c.isalpha() else " " for c in text)
    return {t[i : i + n] for i in range(len(t) - n + 1)}


def test_kernel_against_sets():
    texts = ["The house, and the garden!", "Der Garten und das Haus.", "aa", "ÀÉ 12 x"]
    rows, letters = presence(*text_buffer(pa.array(texts)))
    assert letters.tolist() == [20, 19, 2, 3]
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            want = np.mean([len(grams(x, n) & grams(y, n)) / np.sqrt(max(1, len(grams(x, n))) * max(1, len(grams(y, n)))) for n in (1, 2, 3)])
            assert abs(float(rows[i] @ rows[j]) - want) < 0.02  # up to shared bins


def test_operator(spark):
    prepare(spark)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(5, 40))), lang, 1) for i in range(240) for lang in [rng.choice(list(WORDS))]]
    rows += [(900, None, "en", 1), (901, "", "en", 1), (902, "123 !!", "en", 1), (None, "the house", None, 1), (1, rows[1][1], rows[1][2], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = identify(df).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        assert r.lang_pred == ("und" if r.doc_id in (900, 901, 902) else truth[r.doc_id] if r.doc_id is not None else "en")
    kept = keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert identify(df.limit(0)).count() == 0 and identify(df.where("lang is null")).first().lang_pred == "und"


def test_sample_is_bounded_when_rows_repeat(spark, monkeypatch):
    """One id that stands for thousands of rows is one document of the sample."""
    prepare(spark)
    rows = [(1, f"the cat sat on the mat number {i % 7}", "en") for i in range(3000)] + [(2, "der Hund und die Katze", "de")]
    seen = []
    monkeypatch.setattr(langid, "fit", lambda bits, langs, landmarks: seen.append(langs))
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(seen[0]) == ["de", "en"]
