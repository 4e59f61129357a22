"""SimHash near-duplicates: a Gray-order hierarchical index over 64-bit fingerprints.

Method. Fingerprints that differ in at most three bits agree on at least one of four 16-bit blocks, so the top
nodes of the index are the masked patterns (block, value), and every distinct fingerprint stands under four of
them. Below a top node the fingerprints are sorted by Gray rank, and runs of neighbours are joined into upper
nodes that hold the bits all their members share. A search goes down from the top, adds up the differences
on the shared bits, and drops a whole group once these exceed the limit. A top node with too many members is
split again by the same argument on its remaining bits (four more blocks), until its size is bounded:
no node is capped and no link is lost. A node gives the links of a spanning forest of its members, not all
pairs, and the components of all nodes' links are found by distributed star contraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.runtime import cut

from .common import own_name
from .components import components, join_labels

#: Members of a node that one task searches at once; larger nodes are split again.
NODE_MEMBERS = 4096
FANOUT = 8
_CHUNK = 200_000


def _fingerprint(raw: bytes, width: int, seed: int) -> int:
    words = raw.lower().split()  # both of bytes: A-Z and the ASCII white space only
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    width = min(width, len(words))
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    counts, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 14):
        h = np.array([hash_(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every document's whole text; a text without words has fingerprint zero."""

    def run(batches):
        for batch in batches:
            fp = np.array([_fingerprint((t or "").encode(), width, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    out = fp.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def search(node: np.ndarray, fp: np.ndarray, most: int) -> np.ndarray:
    """Label (least index of its component) of each fingerprint; only those of the same node are compared.

    ``node`` is sorted, and ``fp`` by Gray rank within a node.
    """
    n = len(fp)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [(node, fp, np.full(n, full), None)]  # per level: top node, pattern, shared bits, first child
    while True:
        top, pattern, shared, _ = levels[-1]
        begin = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
        rank = np.arange(len(top)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(top)]))))
        first = np.flatnonzero(rank % FANOUT == 0)
        if len(first) == len(top):
            break
        ones = np.bitwise_and.reduceat(pattern | ~shared, first)
        zeros = np.bitwise_and.reduceat(~pattern | ~shared, first)
        bits = np.bitwise_and.reduceat(shared, first) & (ones | zeros)
        levels.append((top[first], ones & bits, bits, np.concatenate((first, [len(top)]))))
    labels = np.arange(n)
    roots = np.searchsorted(levels[-1][0], node)
    step = max(1, (1 << 20) // max(1, min(n, NODE_MEMBERS)))
    for a in range(0, n, step):
        q = np.arange(a, min(n, a + step))
        at = roots[q]
        for depth in range(len(levels) - 1, -1, -1):
            _, pattern, shared, children = levels[depth]
            near = np.bitwise_count((fp[q] ^ pattern[at]) & shared[at]) <= most
            q, at = q[near], at[near]
            if depth:
                many = children[at + 1] - children[at]
                ends = np.cumsum(many)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(children[at] - (ends - many), many)
                q = np.repeat(q, many)
        later = at > q
        labels = join_labels(labels, q[later], at[later])
    return labels


def _blocks(bits: int, parts: int) -> list[int]:
    """``bits`` cut into ``parts`` masks of neighbouring set bits, sizes differing by one at most."""
    places = [i for i in range(64) if bits >> i & 1]
    cuts = [len(places) * k // parts for k in range(parts + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Links (src, dst) between distinct fingerprints (column fp) that differ in at most ``most`` bits.

    They connect the same components as all such pairs do.
    """
    parts = most + 1
    level = [((1 << 64) - 1, 0)]  # (bits left, mask so far)
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    done = None
    while True:
        nodes = [(left & ~b, mask | b, mask) for left, mask in level for b in _blocks(left, parts)]
        choice = F.create_map(*[x for mask in {m for _, m in level} for x in (F.lit(_signed(mask)), F.array(*[F.lit(_signed(m)) for _, m, of in nodes if of == mask]))])
        rows = rows.select("fp", F.explode(F.element_at(choice, F.col("mask"))).alias("mask"))
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        level = list(dict.fromkeys((left, mask) for left, mask, _ in nodes))
        if max(bin(left).count("1") for left, _ in level) <= NODE_MEMBERS.bit_length() - 1:
            hot = None  # so few bits are left that no node can be too large
        else:
            hot = cut(rows.groupBy("mask", "key").count().where(F.col("count") > NODE_MEMBERS).select("mask", "key"))
        if hot is None or hot.isEmpty():
            done = rows if done is None else done.unionByName(rows)
            break
        calm = rows.join(hot, ["mask", "key"], "left_anti").select("fp", "mask", "key")
        done = calm if done is None else done.unionByName(calm)
        rows = cut(rows.join(hot, ["mask", "key"], "left_semi").select("fp", "mask").distinct())

    def run(batches):
        def found(mask, key, fp):
            fp = fp.view(np.uint64)
            order = np.lexsort((gray_rank(fp), key, mask))
            mask, key, fp = mask[order], key[order], fp[order]
            node = np.cumsum(np.concatenate(([0], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
            labels = search(node, fp, most)
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[labels[moved]].view(np.int64))], names=["src", "dst"])

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(k)) for k in (1, 2, 0)]))
            size += batch.num_rows
            if size >= _CHUNK:  # whole nodes only: the last one may go on
                x = np.concatenate(held, axis=1)
                ends = np.flatnonzero((x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1]))
                if len(ends):
                    yield found(*x[:, : ends[-1] + 1])
                    x = x[:, ends[-1] + 1 :]
                held, size = [x], x.shape[1]
        if size:
            yield found(*np.concatenate(held, axis=1))

    placed = done.select("fp", "mask", "key").repartition("mask", "key").sortWithinPartitions("mask", "key")
    return placed.mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, most: int = 3, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    component_id is the least id reachable over links of at most ``most`` differing bits, itself included;
    null where no document of the component has an id. Null and empty texts have fingerprint zero and link
    like any other; repeated rows give a row each; other columns play no part. Equal fingerprints are
    one entry of the index, so copies cost nothing there.
    """
    marked = cut(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), width, seed, "id"))
    fps = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(fps, most))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    out = marked.join(by_fp, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of one document of each component: that of the least id (null after all others), then of the least hash of its text.

    A document is an id and a text, so an id that stands for several texts loses only those that another document of their
    component answers for, and no component loses all rows. Rows that repeat the kept document in id and text stay once each; of kept
    rows without an id that are alike in text one stays (any, where other columns differ). Null and empty texts are alike to each other; an empty table stays empty; other columns
    are carried along, whatever their names.
    """
    own, of = own_name(docs, "simhash_text"), own_name(docs, "simhash_id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = cut(fingerprints(texts.select(F.struct("id", F.xxhash64("text").alias("h")).alias("x"), "text"), id_col="x").select("x.id", "x.h", "fp").groupBy("id", "h", "fp").count())
    roots = components(links(marked.select("fp").distinct(), most))
    named = marked.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("x"))
    judged = cut(named.join(first, "root").select(F.col("id").alias(of), F.col("h").alias(own), "count", (F.col("id").eqNullSafe(F.col("x.id")) & (F.col("h") == F.col("x.h"))).alias("stays")))

    def without(rows: DataFrame, which: DataFrame, how: str) -> DataFrame:
        return rows.join(which.select(of, own), rows[id_col].eqNullSafe(which[of]) & (F.xxhash64(rows[text_col]) == which[own]), how)

    kept = without(docs, judged.where("not stays"), "left_anti")
    twice = judged.where("stays and count > 1").where(F.col(of).isNull())
    if twice.isEmpty():
        return kept
    some = without(kept, twice, "left_semi").withColumn(own, F.xxhash64(text_col)).dropDuplicates([id_col, own]).drop(own)
    return without(kept, twice, "left_anti").unionByName(some)
