import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitegauge.llm.common import prepare
from sitegauge.llm.shards import DOMAIN, default_folder, materialise, permute, read

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65537])
def test_bijection(n):
    slots = permute(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n))
    assert (permute(np.arange(n), n, 7) == slots).all()
    if n > 100:
        assert (permute(np.arange(n), n, 8) != slots).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.1


def test_cycle_walking():
    numbers = np.concatenate([np.arange(20000), 3 * 10**11 + np.arange(20000)])
    codes = permute(numbers, DOMAIN, 3)
    assert len(set(codes.tolist())) == len(codes) and codes.min() >= 0 and codes.max() < DOMAIN
    share = np.bincount(codes // (DOMAIN // 10), minlength=10)
    assert abs(share - 4000).max() < 400


def test_round_trip(spark):
    prepare(spark)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["one", "zwei", "é", "4"]) for _ in range(rng.randrange(60))), 1) for i in range(50)]
    rows += [(60, None, 1), (61, "", 1), (None, "x", 1), (62, "word " * 3000, 1), (3, rows[3][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    out = default_folder(spark)
    got = materialise(docs, out, PATH, stride=16, shards=5).collect()
    found = list(read(out))
    assert sorted(r.slot for r in got) == list(range(len(got))) and len(found) == len(got)
    assert [(r.shard, r.place) for r in sorted(got, key=lambda r: r.slot)] == sorted((r.shard, r.place) for r in got) and len({r.shard for r in got}) == 5
    texts = {}
    for r in got:
        assert len(found[r.slot]) == r.n_ids <= 16
        texts.setdefault(r.doc_id, []).append((r.piece, found[r.slot].tolist()))
    library = Tokenizer.from_file(PATH)
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [50256]
        pieces = sorted(texts[i])
        if i == 3:  # its row stands twice
            pieces = pieces[::2]
        assert [x for _, p in pieces for x in p] == ids
    assert [x.tolist() for x in read(out, 40, 30)] == [x.tolist() for x in found[40:70]]
    assert materialise(docs.limit(0), default_folder(spark), PATH).count() == 0
