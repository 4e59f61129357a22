import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sitegauge.llm.bpe import load, token_counts
from sitegauge.llm.common import prepare, text_buffer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ours(texts):
    data, bounds = text_buffer(pa.array(texts, pa.string()))
    out = []
    for _, ids, counts in load(PATH).encode(data, bounds):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert load(PATH).counts(data, bounds).tolist() == [len(x) for x in out]
    return out


def theirs(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


CASES = [
    "", None, " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "\n a", " \n", "x \n y", "'s", "it's", "it's 's ' s", "we'll'll", "'re've'm'd't", "'lx 'r",
    "''s", " 's", "\t's", "don't'", "aaaa aaaaaaa", "é è ß", "日本語 テキスト", "12 345 ٣", " x  y", " a", "a　　b", "🙂🙂 x", "<|endoftext|>",
    "a<|endoftext|>b", " <|endoftext|> ", "<|endoftext|><|endoftext|>x", "<|endoftext|", "=" * 300, "abc" * 200, "Ǆ ² Ⅷ", "a​b", "\x1c\x1f \x1c", "x́y", "'S IT'S", "\r\n\r\n", "_a__b", "a.b,c", "'", "' ", "'l", "'ll", "'v",
]


def test_equal_to_the_library(library):
    assert ours(CASES) == theirs(library, CASES)


def test_random_mixtures(library):
    rng = random.Random(3)
    parts = ["a", "the", "'", "s", "re", " ", "  ", "\n", "é", "9", "!", "<|endoftext|>", "\t", "ll", "日", " ", "Zz", "''"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert ours(texts) == theirs(library, texts)


def test_code_points(library):
    texts = ["".join(f"a{chr(c)} {chr(c)}1{chr(c)}" for c in range(b, b + 64) if not 0xD800 <= c < 0xE000) for b in range(0, 0x11000, 64)]
    bad = [i for i, (x, y) in enumerate(zip(ours(texts), theirs(library, texts))) if x != y]
    assert not bad


def test_operator(spark, library):
    prepare(spark)
    rows = [(i, t, "z") for i, t in enumerate(CASES)] + [(None, "x", None), (1, None, "z"), (1, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, PATH, 100).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), len(e), len(e) > 100) for (i, t, _), e in zip(rows, theirs(library, [r[1] for r in rows]))), key=str)
    assert got == want
    assert token_counts(df.limit(0), PATH).count() == 0
