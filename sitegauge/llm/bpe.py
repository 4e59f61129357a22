"""Byte-level BPE over ragged numpy arrays.

Method: rank-synchronous array merging. The pre-tokens of a step of texts lie end to end in one symbol array;
equal pre-tokens are merged once. In every round each pre-token finds its lowest-rank adjacent pair and all
occurrences of that pair merge at the same time; a pre-token without a mergeable pair leaves the array, and
the symbols it has left are its tokens.

The texts are cut into pre-tokens by character classes on the code-point array, equal to the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import STEP_BYTES, ragged, steps, text_buffer

OTHER, LETTER, NUMBER, SPACE, BLANK, EDGE = 0, 1, 2, 3, 4, 255
#: White space of the pattern's \s (fixed values: the Unicode property White_Space).
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Bytes of pre-tokens whose tokens a worker remembers; past that it begins anew.
REMEMBERED = 6 << 20
NO_RANK = np.int64(1 << 40)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    out[32] = BLANK
    return out


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in vocabulary files: itself where printable, else 256, 257 and so on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """A vocabulary file of byte-level BPE, ready for array merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.size = max(vocab.values()) + 2
        self.byte_ids = np.array([vocab[s] for s in _byte_symbols()], np.int64)
        self.specials = [(t["content"].encode(), t["id"]) for t in spec.get("added_tokens", [])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._table(keys)
        self._forget()
        self.powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _table(self, keys: np.ndarray) -> None:
        """An open-addressing table of pair -> rank that whole arrays are looked up in."""
        bits = 1
        while (1 << bits) < 8 * len(keys):
            bits += 1
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = keys[free]  # the last of equal slots wins, the others move on
            won = free[self.slots[at[free]] == keys[free]]
            self.ranks[at[won]] = won
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & mask
        self.mask = mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _P) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = self._slot(keys)
        there = self.slots[at]
        out = np.where(there == keys, self.ranks[at], NO_RANK)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.slots[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def pretokens(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset of every pre-token of the texts data[bounds[i]:bounds[i + 1]], and its special id or -1."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = data.tobytes()
        cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(cps) == len(raw):
            at = np.arange(len(cps) + 1, dtype=np.int64)
        else:
            wide = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
            at = np.concatenate(([0], np.cumsum(wide)))
        edge = np.zeros(len(cps) + 1, bool)
        edge[np.searchsorted(at, bounds)] = True
        special = []
        for content, number in self.specials:
            found = raw.find(content)
            while found >= 0:
                a, b = np.searchsorted(at, (found, found + len(content)))
                if not edge[a + 1 : b].any():  # not across two texts
                    special.append((a, b, number))
                    found = raw.find(content, found + len(content))
                else:
                    found = raw.find(content, found + 1)
        for a, b, _ in special:
            edge[a] = edge[b] = True
        kind = _classes()[cps]
        before, after = np.empty_like(kind), np.empty_like(kind)
        before[0], before[1:] = EDGE, kind[:-1]
        after[-1], after[:-1] = EDGE, kind[1:]
        before[edge[:-1]] = EDGE
        after[edge[1:]] = EDGE
        white, white_before = kind >= SPACE, (before >= SPACE) & (before != EDGE)
        start = np.where(
            white,
            ~white_before | ((after < SPACE) & white_before),
            np.where(white_before, before == SPACE, kind != before),
        )
        start |= edge[:-1]
        quote = np.flatnonzero(start & (cps == 39) & (after == LETTER))
        if len(quote):
            one = cps[quote + 1]
            two = np.where((quote + 2 < len(cps)) & ~edge[np.minimum(quote + 2, len(cps))], cps[np.minimum(quote + 2, len(cps) - 1)], 0)
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = ~single & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            start[quote[single | double] + 1] = False
            follow = np.concatenate((quote[single] + 2, quote[double] + 3))
            start[follow[follow < len(cps)]] = True
        for a, b, _ in special:
            start[a + 1 : b] = False
        where = np.flatnonzero(start)
        ids = np.full(len(where), -1, np.int64)
        for a, _, number in special:
            ids[np.searchsorted(where, a)] = number
        return at[where], ids

    def _distinct(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of one of each distinct pre-token, for each pre-token the number of its like, and the distinct ones' hashes.

        Found by a 64-bit polynomial hash and then compared byte by byte; were two different ones to
        share a hash, none would be joined.
        """
        powers, inverse = self._powers(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])))
        hashed = (sums[starts + lengths] - sums[starts]) * inverse[starts]
        hashed ^= lengths.astype(np.uint64) << np.uint64(40)
        found, first, same = np.unique(hashed, return_index=True, return_inverse=True)
        model = first[same]
        if (lengths[model] == lengths).all():
            if (data[ragged(starts, lengths)] == data[ragged(starts[model], lengths)]).all():
                return first, same, found
        return np.arange(len(starts)), np.arange(len(starts)), hashed

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.powers[0]):
            fresh = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, p, np.uint64)))) for p in (_P, _P_INV)]
            if n > 2 * STEP_BYTES:  # one very long text: not kept
                return fresh[0], fresh[1]
            self.powers = fresh[0], fresh[1]
        return self.powers[0][:n], self.powers[1][:n]

    def tokens(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() with a bounded memory of what this worker has merged before, checked byte by byte."""
        m = self.memory
        at = np.minimum(np.searchsorted(m["hash"], hashed), max(0, len(m["hash"]) - 1))
        known = m["hash"][at] == hashed if len(m["hash"]) else np.zeros(len(hashed), bool)
        row = m["row"][at] if len(m["hash"]) else at
        known[known] = m["length"][row[known]] == lengths[known]
        k = np.flatnonzero(known)
        if len(k):
            equal = data[ragged(starts[k], lengths[k])] == m["bytes"][ragged(m["start"][row[k]], lengths[k])]
            bad = np.repeat(k, lengths[k])[~equal]
            known[bad] = False
        new = np.flatnonzero(~known)
        ids, counts = self.merge(data, starts[new], lengths[new])
        base = len(m["ids"])
        begin, count = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        old = np.flatnonzero(known)
        begin[old], count[old] = m["begin"][row[old]], m["count"][row[old]]
        begin[new], count[new] = base + np.cumsum(counts) - counts, counts
        pool = np.concatenate((m["ids"], ids))
        if len(m["bytes"]) + int(lengths[new].sum()) > REMEMBERED:
            self._forget()
        else:
            m["row"] = np.concatenate((m["row"], len(m["length"]) + np.arange(len(new))))
            joined = np.concatenate((m["hash"], hashed[new]))
            order = np.argsort(joined, kind="stable")
            m["hash"], m["row"] = joined[order], m["row"][order]
            m["start"] = np.concatenate((m["start"], len(m["bytes"]) + np.cumsum(lengths[new]) - lengths[new]))
            m["bytes"] = np.concatenate((m["bytes"], data[ragged(starts[new], lengths[new])]))
            m["length"] = np.concatenate((m["length"], lengths[new]))
            m["begin"], m["count"] = np.concatenate((m["begin"], begin[new])), np.concatenate((m["count"], counts))
            m["ids"] = pool
        return pool[ragged(begin, count)], count

    def _forget(self) -> None:
        self.memory = {k: np.zeros(0, np.int64) for k in ("row", "start", "length", "begin", "count", "ids")}
        self.memory |= {"hash": np.zeros(0, np.uint64), "bytes": np.zeros(0, np.uint8)}

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each pre-token: all ids end to end, and how many each has."""
        n = len(starts)
        counts = np.zeros(n, np.int64)
        symbols, owner = self.byte_ids[data[ragged(starts, lengths)]], np.repeat(np.arange(n), lengths)
        done_ids, done_owner = [], []
        ranks = np.full(len(symbols), NO_RANK, np.int64)
        stale = np.flatnonzero(owner[1:] == owner[:-1])
        while len(symbols):
            ranks[stale] = self.pair_ranks(symbols[stale], symbols[stale + 1])
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(ranks, first)
            lowest = np.repeat(lowest, np.diff(np.concatenate((first, [len(symbols)]))))
            over = lowest == NO_RANK
            chosen = (ranks == lowest) & ~over
            if (chosen[1:] & chosen[:-1]).any():  # a pair overlapping itself: every other one, from the left
                where = np.arange(len(chosen))
                begin = np.maximum.accumulate(np.where(chosen & ~np.concatenate(([False], chosen[:-1])), where, 0))
                chosen &= (where - begin) % 2 == 0
            done_ids.append(symbols[over])
            done_owner.append(owner[over])
            symbols[chosen] = self.merged[ranks[chosen]]
            ranks[chosen] = NO_RANK
            keep = ~over
            keep[1:] &= ~chosen[:-1]
            keep = np.flatnonzero(keep)
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            changed = np.flatnonzero(chosen[keep])
            stale = np.unique(np.concatenate((changed, changed[changed > 0] - 1)))
            stale = stale[stale + 1 < len(symbols)]
            inner = owner[stale] == owner[stale + 1]
            stale = stale[inner]
        if not done_ids:
            return np.zeros(0, np.int64), counts
        ids, whose = np.concatenate(done_ids), np.concatenate(done_owner)
        counts += np.bincount(whose, minlength=n)
        return ids[np.argsort(whose, kind="stable")], counts

    def _step(self, data: np.ndarray, bounds: np.ndarray, with_ids: bool):
        starts, special = self.pretokens(data, bounds)
        lengths = np.diff(np.concatenate((starts, [len(data)])))
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
        first, same, hashed = self._distinct(data, starts, lengths)
        ids, counts = self.tokens(data, starts[first], lengths[first], hashed)
        begin = np.cumsum(counts) - counts
        each = np.where(special >= 0, 1, counts[same])
        total = np.concatenate(([0], np.cumsum(each)))
        in_text = np.searchsorted(starts, bounds)  # a text's pre-tokens begin at its own bound
        per_text = np.diff(total[in_text])
        if not with_ids:
            return None, per_text
        if (special >= 0).any():
            flat = np.empty(total[-1], np.int64)
            usual = special < 0
            flat[total[:-1][~usual]] = special[~usual]
            flat[ragged(total[:-1][usual], each[usual])] = ids[ragged(begin[same[usual]], each[usual])]
        else:
            flat = ids[ragged(begin[same], each)]
        return flat, per_text

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        out = [self._step(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], False)[1] for a, b in steps(bounds)]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, bounds: np.ndarray):
        """(index of the first text, ids end to end, tokens of each text) for one step of texts after another."""
        for a, b in steps(bounds):
            yield a, *self._step(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], True)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """The vocabulary at ``path``, read once in each Python worker."""
    return ByteBpe(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    A null or empty text has 0 bytes and 0 tokens. A null id stays null; repeated rows give a row each;
    other columns, whatever their names, play no part. One narrow pass, no shuffle; a lost task is run anew.
    """

    def run(batches):
        model = load(path)
        for batch in batches:
            data, bounds = text_buffer(batch.column(1))
            n = model.counts(data, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
