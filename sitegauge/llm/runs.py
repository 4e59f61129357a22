"""Periodic runs of words: every stretch of a text that repeats itself with some period, found by the runs theorem.

Method. A run is a maximal stretch of words with smallest period q, here of ``least`` words and ``EXPONENT`` periods or more. By the runs theorem every run holds, in
its first period, a Lyndon word of length q that is the longest one to start at its place, under one of the two orders of the alphabet (the order of
words and its reverse; the end of a text is least in both). The longest Lyndon word at i ends before the next smaller value of the inverse suffix
array. So the inverse suffix array is made under both orders by prefix doubling, its next smaller values give all roots, and a root [i, i + q) is
extended to the right by the longest common extension of i and i + q: a minimum over the LCP array, by a sparse table. To the left the same is done on the reversed words.

What cannot lie in a run is left out first: a run of 24 words and three periods is covered by stretches of 16 words that stand in it twice. Stretches that recur in a
text are told by hashes, where a collision only keeps words that were not needed; the covered segments are handed on, and a run lies in one segment whole.
All steps are array operations over many texts at once. A text's own memory is about 4 * log2(its longest segment) bytes a word for each table.

Defined results: a null or empty text, or one of white space, has no words, no runs and an empty collapsed text. Null ids, repeated rows and equal ids are
texts like any other, a row each. An empty table gives no rows. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ragged, steps, text_buffer
from .passages import _mix, _powers, word_spans

LEAST, EXPONENT = 24, 3
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _mix(np.arange(256, dtype=np.uint64) + _STEP)


class Suffixes:
    """Ranks of the suffixes of many sequences laid end to end, each compared with those of its own sequence only."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, common: bool = True):
        """``common``: whether longest common extensions will be asked for."""
        n = self.n = len(words)
        self.ends = np.repeat(bounds[1:], np.diff(bounds))
        self.levels = max(1, int(np.diff(bounds).max()).bit_length())
        owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
        key = owner * (int(words.max()) + 1) + words
        at = np.argsort(key, kind="stable")
        key, slots = key[at], np.arange(n)
        rank = np.empty(n, np.int32)
        classes, width = [], 1
        while True:
            new = np.concatenate(([True], key[1:] != key[:-1]))
            rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            if common:
                classes.append(rank.copy())
            alike = ~(new & np.concatenate((new[1:], [True])))
            at = at[alike]
            if not len(at):
                break
            after = at + width
            inside = after < self.ends[at]
            own = rank[at].astype(np.int64)
            key = own * (n + 2) + np.where(inside, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            first = np.concatenate(([True], own[1:] != own[:-1]))  # own is sorted, and stays so
            slots = own + np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            width *= 2
        self.rank = rank
        if common:
            self.least = self._table(self._lcp(classes, owner))

    def _lcp(self, classes: list[np.ndarray], owner: np.ndarray) -> np.ndarray:
        """The words that each suffix has in common with the one ranked before it: the doubling's classes, longest first."""
        order = np.empty(self.n, np.int64)
        order[self.rank] = np.arange(self.n)
        a, b = order[:-1].copy(), order[1:].copy()
        stop_a, stop_b, same = self.ends[a], self.ends[b], owner[a] == owner[b]
        out = np.zeros(self.n, np.int32)
        for k in range(len(classes) - 1, -1, -1):
            inside = same & (a < stop_a) & (b < stop_b)
            step = np.flatnonzero(inside)
            step = step[classes[k][a[step]] == classes[k][b[step]]]
            a[step] += 1 << k
            b[step] += 1 << k
            out[step + 1] += 1 << k
        return out

    def _table(self, values: np.ndarray) -> np.ndarray:
        """Row k: the least of the 2^k values from each place on."""
        table = np.empty((self.levels, self.n), np.int32)
        table[0] = values
        for k in range(1, self.levels):
            half = 1 << (k - 1)
            table[k] = table[k - 1]
            np.minimum(table[k - 1, :-half], table[k - 1, half:], out=table[k, :-half])
        return table

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and j (other places of one sequence) have in common."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp(high - low + 1)[1] - 1
        return np.minimum(self.least[k, low], self.least[k, high - (1 << k) + 1])

    def next_smaller(self) -> np.ndarray:
        """For each place the next one of its sequence with a smaller suffix, else the sequence's end."""
        table = self._table(self.rank)
        at = np.arange(1, self.n + 1)
        for k in range(self.levels - 1, -1, -1):
            step = np.flatnonzero(at + (1 << k) <= self.ends)
            step = step[table[k, at[step]] > self.rank[step]]
            at[step] += 1 << k
        return at


def runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (sequence, start, length, period) of all runs of the sequences ``words[bounds[k]:bounds[k + 1]]``, in order; words are numbers from 0."""
    none = np.zeros((0, 4), np.int64)
    if not len(words):
        return none
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    length = np.diff(bounds)[owner]
    forward = Suffixes(words, bounds)
    found = []
    for order in (forward, Suffixes(words.max() - words, bounds, False)):
        at = order.next_smaller()
        period = at - np.arange(len(words))
        root = np.flatnonzero((at < order.ends) & (EXPONENT * period <= length))
        period = period[root]
        right = forward.common(root, root + period)
        long = right >= np.maximum(least - 2 * period, (EXPONENT - 2) * period)
        found.append(np.stack((root[long], period[long], right[long]), axis=1))
    found = np.concatenate(found)
    if not len(found):
        return none
    root, period, right = found.T
    backward = Suffixes(words[::-1].copy(), len(words) - bounds[::-1])
    left = np.zeros(len(root), np.int64)
    inner = np.flatnonzero(root > bounds[owner[root]])
    last = len(words) - root[inner]
    left[inner] = backward.common(last, last - period[inner])
    total = left + period + right
    full = (total >= least) & (total >= EXPONENT * period)
    out = np.stack((owner[root], root - left - bounds[owner[root]], total, period), axis=1)[full]
    return np.unique(out[:, [0, 1, 3, 2]], axis=0)[:, [0, 1, 3, 2]]


def _covered(hashed: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the segments that are covered by stretches of ``size`` words which recur in their own sequence."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(hashed) < size:
        return none
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    gram, width = hashed, 1
    while width < size:
        wide = min(width, size - width)
        gram = _mix(gram[:-wide] * _STEP + gram[wide:])
        width += wide
    whole = np.flatnonzero(owner[: len(gram)] == owner[size - 1 :])
    gram = gram[whole] ^ _mix(owner[whole].astype(np.uint64) + _STEP)
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    if not same.any():
        return none
    live = np.zeros(len(whole), bool)
    live[order[1:][same]] = live[order[:-1][same]] = True
    live = whole[live]
    edge = np.zeros(len(hashed) + 1, np.int32)
    edge[live] += 1
    edge[live + size] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    cut = np.zeros(len(hashed) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends


def text_runs(data: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the texts in a buffer, as rows (text, start, length, period), and the words' starts, ends and where each text's begin."""
    starts, ends, first = word_spans(data, bounds)
    none = np.zeros((0, 4), np.int64), starts, ends, first
    if len(starts) < least:
        return none
    powers, inverse = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers[:-1])))
    hashed = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    size = least - least // EXPONENT  # a run is covered by stretches of so many words that recur in it at the distance of its period
    a, b = _covered(hashed, first, size)
    for _ in range(2):  # a repeat outside of the segment does not count
        keep = b - a >= least
        a, b = a[keep], b[keep]
        if not len(a):
            return none
        at = np.concatenate(([0], np.cumsum(b - a)))
        places = ragged(a, b - a)
        c, d = _covered(hashed[places], at, size)
        a, b = (places[c], places[d - 1] + 1) if len(c) else (c, d)
    keep = b - a >= least
    a, b = a[keep], b[keep]
    if not len(a):
        return none
    places = ragged(a, b - a)
    sizes = ends[places] - starts[places]
    held = np.concatenate(([0], np.cumsum(sizes)))
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(held), pa.py_buffer(data[ragged(starts[places], sizes)])])
    words = spelled.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = runs(words, np.concatenate(([0], np.cumsum(b - a))), least)
    text = np.searchsorted(first, a[rows[:, 0]], "right") - 1
    rows[:, 1] += a[rows[:, 0]] - first[text]
    rows[:, 0] = text
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))], starts, ends, first


def _collapsed(raw: bytes, rows: np.ndarray) -> bytes:
    words = raw.split()
    if not len(rows):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, rows[:, 1] + rows[:, 3], 1)
    np.add.at(edge, rows[:, 1] + rows[:, 2], -1)
    return b" ".join(w for w, dropped in zip(words, np.cumsum(edge).tolist(), strict=False) if not dropped)


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its runs (array of start, length, period in words, by start, then period) and ``collapsed``: the words that no run holds after its first period, parted by one space."""

    def work(batches):
        for batch in batches:
            data, bounds = text_buffer(batch.column(1))
            counts, found, texts = [], [], []
            for a, b in steps(bounds):
                own, at = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                rows = text_runs(own, at, least)[0]
                cuts = np.searchsorted(rows[:, 0], np.arange(b - a + 1))
                counts.append(np.diff(cuts))
                found.append(rows[:, 1:])
                raw = own.tobytes()
                texts += [_collapsed(raw[at[k] : at[k + 1]], rows[cuts[k] : cuts[k + 1]]) for k in range(b - a)]
            found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else [0]
            spans = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found.T], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), pa.array(texts, pa.binary()).cast(pa.string())], names=[id_col, "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_periodic_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as the query reads them: where h = crc32 of the decimal id is a multiple of ten, the words from a on repeat with period p. A null id has no h."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.col("words")
    p = 1 + F.floor((F.size(words) - F.col("a")) / (3 + g % 8))
    tail = F.transform(words, lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get(words, (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    split = docs.select(id_col, text_col, F.when(h % 10 == 0, F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)"))).alias("words"))
    split = split.withColumn("a", F.when(F.size(words) > 0, g % F.size(words))).withColumn("p", p)
    return split.select(id_col, F.when(F.size(words) > 0, F.array_join(tail, " ")).otherwise(F.col(text_col)).alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of ``periodic_runs``: number of runs, the run of greatest exponent (ties: first start, then period), digests of all runs and of the collapsed text."""

    def greater(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run.length * best.period > best.length * run.period), run).otherwise(best)

    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), greater)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    out = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    top = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return out.select(id_col, "n_runs", *top, F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
