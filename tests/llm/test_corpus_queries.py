"""The registered queries over the smallest tables: against their SQL, or against plain forms of the contract."""

import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitegauge.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text, lang from '{DATA}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_tokens_and_packing(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in documents}
    got = queries.op1_token_counts(spark, str(DATA)).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {(i, len((t or "").encode()), len(ids[i]), len(ids[i]) > 1024) for i, t, _ in documents}
    rows = queries.op2_best_fit_packing(spark, str(DATA)).collect()
    held, length = defaultdict(list), Counter()
    for r in rows:
        own = ids[r.doc_id] + [2]
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own[r.start : r.start + r.length])) == r.ids_crc32
        held[r.sequence_id].append((r.offset, r.length))
        length[r.doc_id] += r.length
    assert all(length[i] == len(x) + 1 for i, x in ids.items())
    for x in held.values():
        assert [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 1024
    assert len(held) <= math.ceil(1.02 * sum(length.values()) / 1024) + 1


def test_language(spark, documents):
    truth = {i: lang for i, _, lang in documents}
    got = queries.op9_language_id(spark, str(DATA)).collect()
    assert len(got) == len(documents)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_passages(spark, documents):
    """Of every 50 words that stand in several documents, all but one document's are in a row."""
    words = {i: (t or "").encode().lower().split() for i, t, _ in documents}
    where = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add((i, k))
    covered = defaultdict(set)
    for r in queries.op7_substring_dedup(spark, str(DATA)).collect():
        covered[r.doc_id] |= set(range(r.start_word, r.end_word + 1))
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            assert len({i for i, k in places if not covered[i] >= set(range(k, k + 50))}) <= 1


def test_near_duplicates(spark, documents):
    """Fingerprints by definition, groups by all pairs."""
    from test_simhash import brute, plain

    ids, fps = [i for i, _, _ in documents], [plain(t) for _, t, _ in documents]
    order = sorted(range(len(ids)), key=lambda k: ids[k])
    roots = brute([fps[k] for k in order])
    want = {(ids[k], f"{fps[k]:016x}", ids[order[r]]) for k, r in zip(order, roots, strict=True)}
    got = queries.op6_simhash(spark, str(DATA)).collect()
    assert len(got) == len(documents) and {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want


def test_leaks(spark, documents):
    """Every document against every item by the plain table of edit distances, all items a step."""
    import numpy as np

    from sitegauge.llm.decontam import budget, fold

    items = [(i, fold(t)) for i, t in duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()]
    wide = max(len(t) for _, t in items)
    pattern = np.array([[ord(c) for c in t] + [0] * (wide - len(t)) for _, t in items])
    most, last, along = np.array([budget(t) for _, t in items]), np.array([len(t) for _, t in items]), np.arange(wide + 1, dtype=np.int32)
    want = set()
    for i, text, _ in documents:
        row, found = np.tile(along, (len(items), 1)), np.zeros(len(items), bool)
        differs = {c: (pattern != ord(c)).astype(np.int32) for c in set(fold(text or ""))}
        for c in fold(text or ""):
            new = np.empty_like(row)
            new[:, 0] = 0
            np.minimum(row[:, 1:] + 1, row[:, :-1] + differs[c], out=new[:, 1:])
            row = np.minimum.accumulate(new - along, axis=1) + along
            found |= row[np.arange(len(items)), last] <= most
        want |= {(i, items[k][0]) for k in np.flatnonzero(found)}
    got = {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, str(DATA)).collect()}
    assert got == want and len(want) >= 3


def test_shards(spark, documents, tmp_path, monkeypatch):
    """Every sequence of the registered query lies at its slot, with the library's ids."""
    from sitegauge.llm import shards

    monkeypatch.setattr(shards, "default_folder", lambda spark: str(tmp_path / "shards"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op5_binary_shards(spark, str(DATA)).collect()
    found = list(shards.read(str(tmp_path / "shards")))
    assert sorted(r.slot for r in rows) == list(range(len(rows))) == list(range(len(found)))
    held = defaultdict(list)
    for r in rows:
        assert zlib.crc32(found[r.slot].astype("<u4").tobytes()) == r.ids_crc32 and len(found[r.slot]) == r.n_ids
        held[r.doc_id].append((r.piece, found[r.slot].tolist()))
    for i, t, _ in documents:
        assert [x for _, p in sorted(held[i]) for x in p][: len(t or "")] and [x for _, p in sorted(held[i]) for x in p][:-1] == library.encode(t or "", add_special_tokens=False).ids
    by_slot = [r.doc_id for r in sorted(rows, key=lambda r: r.slot)]
    assert by_slot != sorted(by_slot)


def test_pages(spark):
    """The registered query against plain induction over each host, and against the article as the pages' makers put it."""
    import html
    import re

    from sitegauge.llm.wrapper import induce, main_text

    pages = duckdb.sql(f"select page_id, url, html from '{DATA}/pages.parquet'").fetchall()
    hosts = defaultdict(list)
    for i, url, page in pages:
        hosts[re.sub(r"^[a-z]+://([^/?#]*).*$", r"\1", url or "").lower()].append((i, page))
    want = {}
    for own in hosts.values():
        keys, roots = induce([p for _, p in own])
        want |= {i: main_text(p, frozenset(keys), roots) for i, p in own}
    got = {r.page_id: r for r in queries.op10_html_extraction(spark, str(DATA)).collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    for i, _, page in pages:
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", page, re.S)[1])
        assert got[i].text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())
