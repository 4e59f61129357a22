"""Very long texts, empty tables, null ids and clashing names, for the operators whose own tests are on short texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sitegauge.llm import bpe, langid, packing, passages, quality, simhash
from sitegauge.llm.common import STEP_BYTES, prepare

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    text = " ".join(rng.choice(words) for _ in range(500_000))
    assert len(text.encode()) > STEP_BYTES
    return text


def test_tokens_of_long_texts(spark, long_text):
    """A text over one step, and one between texts that fill a step."""
    prepare(spark)
    rows = [(1, long_text), (2, "short"), (3, long_text[: STEP_BYTES // 2]), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    library = Tokenizer.from_file(PATH)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(docs, PATH, 1024).collect()} == {i: len(x) for i, x in want.items()}
    pieces = packing.token_pieces(docs.where("doc_id = 1"), PATH, 1024, 2).collect()
    ids = np.array([*want[1], 2], "<u4")
    assert sorted((r.start, r.length, r.ids_crc32) for r in pieces)[:3] == sorted((r.start, r.length, zlib.crc32(ids[r.start : r.start + r.length].tobytes())) for r in pieces)[:3]
    assert sum(r.length for r in pieces) == len(ids)


def test_fingerprint_of_long_texts(long_text):
    """More shingles than one hashing step has, against the definition."""
    import xxhash

    words = long_text.split()[:40_000]
    counts, n = np.zeros(64, np.int64), len(words) - 2
    for k in range(n):
        h = xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42)
        counts += np.array([h >> b & 1 for b in range(64)])
    assert simhash._fingerprint(" ".join(words).encode(), 3, 42) == sum(1 << b for b in range(64) if 2 * counts[b] > n)


def test_passages_of_long_texts(spark, long_text):
    """A passage at the far end of a text over one step is found, and nothing else of it."""
    prepare(spark)
    rng = random.Random(8)
    passage = " ".join(f"x{rng.randrange(10**6)}" for _ in range(60))
    docs = spark.createDataFrame([(1, long_text + " " + passage), (2, "lead in " + passage + " and out")], "doc_id long, text string")
    got = passages.repeated_passages(docs).collect()
    assert len(got) == 1 and {got[0].doc_id, got[0].other_id} == {1, 2} and got[0].end_word - got[0].start_word + 1 >= 60


def test_language_of_long_texts(spark, long_text):
    prepare(spark)
    rows = [(i, " ".join(random.Random(i).choices("the and of with that there house which".split(), k=40)), "en") for i in range(30)]
    rows += [(100 + i, " ".join(random.Random(i).choices("der und mit das nicht eine häuser straße".split(), k=40)), "de") for i in range(30)]
    rows += [(200, "der und mit das nicht " * 120_000, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[200].lang_pred == "de" and 0 <= got[200].score <= 1


def test_kernel_ridge_against_closed_form():
    """With every sample a landmark the scores are those of weighted kernel ridge regression on the kernel matrix itself."""
    rng = random.Random(2)
    words = {"en": "the and of with that there".split(), "de": "der und mit das nicht eine".split(), "fr": "le les avec pour maison dans".split()}
    langs = [lang for lang in words for _ in range(12)]
    texts = [" ".join(rng.choices(words[x], k=20)) for x in langs]
    new = [" ".join(rng.choices(words[x], k=15)) for x in ("de", "fr", "en", "de")]

    def rows(batch):
        raw = [t.encode() for t in batch]
        return langid.presence(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[0].astype(np.float64)

    x, y = rows(texts), rows(new)
    names, matrix = langid.fit([np.packbits(r > 0).tobytes() for r in x], langs, landmarks=len(texts))
    got = y @ matrix
    k, target = x @ x.T, np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = len(langs) / len(names) / 12
    want = (y @ x.T) @ np.linalg.solve(weight * k + langid.RIDGE * np.eye(len(texts)), weight * target)
    assert np.abs(got - want).max() < 1e-2 and (got.argmax(axis=1) == want.argmax(axis=1)).all()


def test_pipeline_edges(spark, tmp_path):
    """No document at all, and null ids, null texts and repeated rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("passage_uid", pa.int64())])
    item = "what is the colour of the seventh house in the long row of houses"
    rng = random.Random(4)
    texts = [" ".join(rng.choices("the house of that there with and which".split(), k=30)) + f" number {i}" + " ".join(rng.choices("abcdefgh", k=30)) for i in range(40)]
    rows = [(i, t, "en", "s", len(t), i) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1, None), (None, None, None, None, None, None), (3, texts[3], "en", "s", 1, 5), (None, "the house and " + item, "en", "s", 1, 1)]
    for name, part in (("none", []), ("some", rows)):
        folder = tmp_path / name
        folder.mkdir()
        pq.write_table(pa.table({f.name: pa.array([r[k] for r in part], f.type) for k, f in enumerate(schema)}), folder / "documents.parquet")
        pq.write_table(pa.table({"item_id": pa.array([None, 2], pa.int64()), "text": [item, None]}), folder / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    ids = [r.doc_id for r in got]
    assert None not in ids  # its text is that of document 0, or holds the item, or is null
    assert set(ids) <= set(range(40)) and len(set(ids)) >= 1


def test_quality_of_long_texts(long_text):
    n_words, chars, *_, kept, failed, left = quality.judge(long_text)
    assert n_words == 500_000 and chars == sum(len(w) for w in long_text.split())
