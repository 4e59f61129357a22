"""Benchmark decontamination by pigeonhole edit matching.

Method: an item of n characters may be met with up to k = floor(rate * n) edits. It is cut into k + 1 pieces, one
of which must then stand in the text unchanged. Pieces go in pairs (one more piece where k + 1 is odd), and by the same argument
some pair has one unchanged piece and at most one edit in the other. An automaton finds all exact hits of
all pieces in one pass over the whole text; a hit whose partner beside it has more than one edit ends there, and for the
others Myers' bit-parallel distance decides on the stretch where the item could lie. Letters are compared
lower-cased and any white space as a blank, character by character (fold()). Items under ``LEAST_CHARS`` characters are met
only unchanged and as whole words.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.1
#: Items with fewer characters are searched without edits, between word bounds.
LEAST_CHARS = 25
#: Bytes of items that are searched at once; more are taken in blocks of hash slots, each a pass over the documents.
BLOCK_BYTES = 8 << 20
FIELDS = "item_id long, start long, end long, distance int"


_BLANKS = {c: " " for c in range(0x3001) if chr(c).isspace()}


def fold(text: str) -> str:
    """Lower-cased, either small sigma as the medial one, a blank for each white space; every character in its old place.

    Each character folds by itself, so an item and a text fold alike whatever stands around. The one letter whose small form is two
    characters (U+0130) stays as it is.
    """
    if not text.isascii():
        text = "\u0130".join(part.replace("Σ", "σ").lower().replace("ς", "σ") for part in text.split("\u0130"))
        return text.translate(_BLANKS)
    return text.lower().translate(_BLANKS)


def distances(pattern: str, text: str, most: int):
    """(end, distance) for every end in ``text`` where the pattern ends with at most ``most`` edits (Myers, 1999)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
        if score <= most:
            yield j + 1, score


def budget(item: str, rate: float = RATE) -> int:
    return int(rate * len(item) + 1e-9)


def one_edit_after(piece: str, text: str, at: int) -> bool:
    """Whether ``text`` from ``at`` on begins with ``piece`` but for one edit at most."""
    n = len(piece)
    if text.startswith(piece, at):
        return True
    i = 0
    while at + i < len(text) and text[at + i] == piece[i]:
        i += 1
    rest = piece[i + 1 :]
    return text.startswith(rest, at + i + 1) and at + i < len(text) or text.startswith(rest, at + i) or at + i < len(text) and text.startswith(piece[i:n], at + i + 1)


def one_edit_before(piece: str, text: str, at: int) -> bool:
    """Whether ``text`` up to ``at`` ends with ``piece`` but for one edit at most."""
    n = len(piece)
    return one_edit_after(piece[::-1], text[max(0, at - n - 1) : at][::-1], 0)


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no word of ``text`` goes on over either end of a stretch."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE, least: int = LEAST_CHARS):
        import ahocorasick

        self.items = [(i, fold(t)) for i, t in items if t and not t.isspace()]
        self.short = [len(t) < least for _, t in self.items]
        self.most = [0 if short else budget(t, rate) for (_, t), short in zip(self.items, self.short)]
        pieces: dict[str, list[tuple[int, int, str, bool]]] = {}
        for x, ((_, t), k) in enumerate(zip(self.items, self.most)):
            count = k + 1 + (k + 1) % 2 if k else 1
            cuts = [len(t) * p // count for p in range(count + 1)]
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                partner = "" if count == 1 else t[cuts[p - 1] : a] if p % 2 else t[b : cuts[p + 2]]
                pieces.setdefault(t[a:b], []).append((x, a, partner, bool(p % 2)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, distance) of every stretch that is within its item's budget; the best of those that touch."""
        if not self.items or not text:
            return []
        text = fold(text)
        stretches: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for x, a, partner, before in where:
                if partner and not (one_edit_before(partner, text, end + 1 - size) if before else one_edit_after(partner, text, end + 1)):
                    continue
                if self.short[x] and not whole_words(text, end + 1 - size, end + 1):
                    continue
                k = self.most[x]
                begin = end + 1 - size - a
                lo, hi = max(0, begin - k), min(len(text), begin + len(self.items[x][1]) + k)
                if hi - lo < len(self.items[x][1]) - k:
                    continue
                own = stretches.setdefault(x, [])
                if own and lo <= own[-1][1] and not self.short[x]:
                    own[-1][0], own[-1][1] = min(lo, own[-1][0]), max(hi, own[-1][1])
                else:
                    own.append([lo, hi])
        out = []
        for x, own in stretches.items():
            number, item = self.items[x]
            for lo, hi in own:
                near: list[tuple[int, int]] = []  # best (distance, end) of each run of ends
                last = -2
                for end, d in distances(item, text[lo:hi], self.most[x]):
                    if end == last + 1:
                        near[-1] = min(near[-1], (d, end))
                    else:
                        near.append((d, end))
                    last = end
                for d, end in near:
                    end += lo
                    size = next(n for n, s in distances(item[::-1], text[max(lo, end - len(item) - d) : end][::-1], d) if s == d)
                    out.append((number, end - size, end, d))
        return sorted(set(out), key=lambda m: (m[0] is not None, m))


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(key: tuple, items: list[tuple[int, str]], rate: float, least: int) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate, least)
    return _MATCHERS[key]


def item_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES, item_col: str = "item_id", text_col: str = "text"):
    """The items in blocks of hash slots, one after the other; the driver holds one block at a time.

    The slots are made finer until the largest has at most ``most`` bytes (or is one item), by a count before any block is fetched.
    """
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).distinct()
    slots = 1 + (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // most
    while True:
        slot = F.pmod(F.xxhash64("i", "t"), F.lit(slots))
        sizes = items.groupBy(slot.alias("slot")).agg(F.sum(F.octet_length("t")).alias("bytes"), F.count("*").alias("n"))
        worst = sizes.where(F.col("n") > 1).agg(F.max("bytes")).first()[0] or 0
        if worst <= 2 * most:
            break
        slots *= 2
    for s in range(slots):
        yield [tuple(r) for r in items.where(slot == s).orderBy("i", "t").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every stretch of a document that is an item with at most floor(``rate`` x its characters) edits.

    id, item_id, start and end (characters of the text), distance. Null and empty texts and
    items match nothing; items under ``least`` characters only as whole words without edits; a null item_id stays null; documents without a match give no row; rows with a
    null id and repeated rows give their matches like any other. Equal items each match. One narrow pass for each block
    of items; the documents are never shuffled.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    for n, items in enumerate(item_blocks(benchmark)):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent, key=(n, sum(len(t) for _, t in items), rate, least, hash(tuple(items)))):
            matcher = _matcher(key, sent.value, rate, least)
            for batch in batches:
                rows, found = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    for m in matcher.find(text or ""):
                        rows.append(k), found.append(m)
                columns = list(zip(*found)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.int32())],
                    names=[id_col, "item_id", "start", "end", "distance"],
                )

        one = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {FIELDS}")
        out = one if out is None else out.unionByName(one)
    return out


def drop_leaky(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST_CHARS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no item is found.

    Null and empty texts hold no item and stay, as do all rows when there is no item; ids play no part, repeated rows go or stay together,
    and other columns are carried along.
    """
    spark, place = docs.sparkSession, docs.columns.index(text_col)
    for n, items in enumerate(item_blocks(benchmark)):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent, key=(n, sum(len(t) for _, t in items), rate, least, hash(tuple(items)))):
            matcher = _matcher(key, sent.value, rate, least)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t or "") for t in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
