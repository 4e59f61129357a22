import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq

from sitegauge.llm.decontam import Matcher
from sitegauge.llm.simhash import _fingerprint

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "ch ei en sch ung ü ä st zu ge".split()}


def make(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 6))) for _ in range(n)]


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(9)
    texts = [(make(rng, lang, rng.randrange(60, 160)), lang) for _ in range(60) for lang in ("en", "de")]
    passage, item = make(rng, "en", 70), " ".join(make(rng, "de", 25))
    for k in (3, 30, 77):
        texts[k][0][20:20] = passage
    texts[11] = (texts[10][0][:-1] + ["other"], texts[10][1])
    texts[12] = texts[10]
    rows = [(i, " ".join(w), lang) for i, (w, lang) in enumerate(texts)]
    rows[40] = (40, rows[40][1] + " " + item, rows[40][2])
    rows += [(500, None, "en"), (501, "", None), (502, "1234 !!!", "en")]
    docs = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows], "source": ["s"] * len(rows), "n_chars": [len(r[1] or "") for r in rows]})
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), tmp_path / "benchmark.parquet")
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == df.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        df = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append({r.doc_id: r for r in df.collect()})
    everything = set(range(120))
    assert set(kept[0]) == everything
    near = lambda a, b: bin(_fingerprint(rows[a][1].encode(), 3, 42) ^ _fingerprint(rows[b][1].encode(), 3, 42)).count("1") <= 3
    assert near(10, 12) and set(kept[1]) == everything - {12} - ({11} if near(10, 11) else set())
    assert sum(" ".join(passage) in r.text for r in kept[2].values()) == 1
    assert all(r.text == rows[i][1] and r.n_chars == len(r.text) for i, r in kept[2].items() if i not in (3, 10, 11, 30, 77))
    assert all(r.n_chars == len(r.text) for r in kept[2].values())
    assert set(kept[3]) == {i for i, r in kept[2].items() if not Matcher([(1, item)]).find(r.text)} and 40 not in kept[3]
    assert set(kept[4]) == set(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == df.count()
