import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sitegauge.llm.common import prepare
from sitegauge.llm.packing import pack_documents, sweep

PATH = public_tokenizers.path("byte_bpe_50k.json")


def decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_sweep_is_best_fit_decreasing():
    rng = random.Random(5)
    for capacity in (7, 16, 50):
        for _ in range(60):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 120))] + [rng.randint(1, 3)] * rng.randrange(40)
            plan = sweep(dict(Counter(lengths)), capacity)
            held = defaultdict(list)
            for n, _, many, each, first, offset in plan.tolist():
                for s in range(many):
                    held[first + s] += [(offset + i * n, n) for i in range(each)]
            assert Counter(n for x in held.values() for _, n in x) == Counter(lengths)
            for x in held.values():
                at = 0
                for offset, n in sorted(x):
                    assert offset == at
                    at += n
                assert at <= capacity
            assert len(held) == decreasing(lengths, capacity)


def test_documents(spark):
    prepare(spark)
    rng = random.Random(1)
    texts = [None, "", "a", *("word " * rng.randrange(400) for _ in range(120)), *["same text here"] * 40]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "x y z", 2), (3, texts[3], 1)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH, 64).collect()
    library, want = Tokenizer.from_file(PATH), Counter()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        a, b, k = 0, len(ids) % 64 or 64, 0
        while a < len(ids):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            a, b, k = b, b + 64, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 64
    assert len(held) == decreasing([r.length for r in got], 64)
    assert pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int").limit(0), PATH).count() == 0
