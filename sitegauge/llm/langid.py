"""Language identification with a string kernel.

Method: the kernel of two texts is the mean over n = 1, 2, 3 of |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), G being the set of
character n-grams present (blended spectrum, presence only; letters lower-cased, anything else a blank; n-grams
stand in hashed bins, ``BINS`` for each n). A bounded sample of labelled documents is mapped by Nystroem landmarks, and
kernel ridge regression is fitted one language against the rest. The kernel is linear in the presence rows, so landmarks,
their inverse square root and the regression are multiplied once into one matrix, and texts are scored by
products of batches of presence rows with it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, _classes
from .common import steps, text_buffer

#: Bins of the n-grams of length 1, 2, 3.
BINS = (1 << 11, 1 << 13, 1 << 15)
#: Bounds of the sample: labelled documents of each language that are fitted, and landmarks in all.
PER_LANGUAGE, LANDMARKS = 256, 192
RIDGE, SHARPNESS = 1e-2, 6.0
UNDETERMINED = "und"
_ROWS = 64


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower-cased code point of each letter; a blank for all others."""
    out = np.full(0x110000, 32, np.uint32)
    letters = np.flatnonzero(_classes() == LETTER)
    out[letters] = [ord(chr(c).lower()[0]) for c in letters.tolist()]
    return out


def presence(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of scaled presence (row . row = the kernel), and how many letters each text has."""
    rows, width = len(bounds) - 1, sum(BINS)
    out = np.zeros((rows, width), np.float32)
    letters = np.zeros(rows, np.int64)
    for k in range(rows):  # one text at a time: its code points are all that is held beside the rows
        c = np.frombuffer(data[bounds[k] : bounds[k + 1]].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if not len(c):
            continue
        letters[k] = np.count_nonzero(_classes()[c] == LETTER)
        c = _folded()[c]
        code, at = c, 0
        for n, bins in enumerate(BINS):
            if n:
                code = code[:-1] * np.uint32(0x01000193) + c[n:]
            if not len(code):
                break
            own = out[k, at : at + bins]
            own[(code * np.uint32(0x9E3779B1)) >> np.uint32(33 - bins.bit_length())] = 1
            own *= np.float32(1 / np.sqrt(len(BINS) * max(1, np.count_nonzero(own))))
            at += bins
    return out, letters


def unpacked(bits: list[bytes]) -> np.ndarray:
    """Scaled presence rows from their packed presence."""
    out = np.stack([np.unpackbits(np.frombuffer(b, np.uint8))[: sum(BINS)] for b in bits]).astype(np.float32)
    at = 0
    for bins in BINS:
        own = out[:, at : at + bins]
        own /= np.sqrt(len(BINS) * np.maximum(1, own.sum(axis=1, keepdims=True)))
        at += bins
    return out


def fit(bits: list[bytes], langs: list[str], landmarks: int = LANDMARKS) -> tuple[list[str], np.ndarray]:
    """The languages and the matrix (presence columns x languages) of their regressions.

    Only the landmarks' rows are held unpacked; the sample passes in blocks.
    """
    names = sorted(set(langs))
    place = {name: 0 for name in names}
    turn = []  # the sample in turns of one document of each language, so that landmarks cover all
    for i, lang in enumerate(langs):
        turn.append((place[lang], lang, i))
        place[lang] += 1
    chosen = unpacked([bits[i] for _, _, i in sorted(turn)[:landmarks]])
    values, vectors = np.linalg.eigh((chosen @ chosen.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([unpacked(bits[a : a + _ROWS]) @ chosen.T for a in range(0, len(bits), _ROWS)]).astype(np.float64)
    mapped = kernel @ root
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1 / np.array([place[x] for x in langs], float)[:, None]
    weight *= len(langs) / len(names)
    w = np.linalg.solve(mapped.T @ (mapped * weight) + RIDGE * np.eye(mapped.shape[1]), mapped.T @ (target * weight))
    return names, chosen.T @ (root @ w).astype(np.float32)


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray] | None:
    """Fit on at most ``per_language`` documents of each language, none of them held out; None without any.

    The sample is one document (that of least hash) of each of ``per_language`` hash slots; an id that stands for several rows
    is one document, with the text of least hash. Only its ids and packed presence bits come to the driver, so the bound holds for any
    number and length of texts and any repetition of rows.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    labelled = d.where(~_held_out("id") & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.xxhash64("id")
    slots = labelled.groupBy("lang", F.pmod(h, F.lit(per_language)).alias("slot")).agg(F.min(F.struct(h.alias("h"), F.col("id"))).alias("x"))
    picked = slots.select(F.col("x.id").alias("id"), "lang")

    def run(batches):
        for batch in batches:
            data, bounds = text_buffer(batch.column(1))
            for k in range(len(bounds) - 1):
                row, letters = presence(data[bounds[k] : bounds[k + 1]], np.array([0, bounds[k + 1] - bounds[k]]))
                if letters[0]:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([np.packbits(row[0] > 0).tobytes()], pa.binary())], names=["lang", "bits"])

    # per_language ids of each language; of an id with several rows the least text by hash, found by a partial aggregate
    chosen = labelled.join(F.broadcast(picked), ["id", "lang"], "left_semi")
    one = chosen.groupBy("id", "lang").agg(F.min(F.xxhash64("text")).alias("h"))
    chosen = chosen.withColumn("h", F.xxhash64("text")).join(F.broadcast(one), ["id", "lang", "h"], "left_semi")
    chosen = chosen.groupBy("id", "lang").agg(F.first("text").alias("text"))  # rows alike in all three
    found = sorted((r.lang, bytes(r.bits)) for r in chosen.select("lang", "text").mapInArrow(run, "lang string, bits binary").collect())
    if not found:
        return None
    return fit([b for _, b in found], [x for x, _ in found], landmarks)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (0 to 1).

    Without ``model`` one is fitted first. A null text, one without a letter, or any text when nothing was
    learned is ``und`` with score 0. A null id is never held out nor learned from; repeated rows give a row
    each; other columns play no part. One narrow pass.
    """
    model = model or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    names, matrix = model or ([UNDETERMINED], np.zeros((sum(BINS), 1), np.float32))
    sent = docs.sparkSession.sparkContext.broadcast(matrix)  # bins x languages

    def run(batches):
        for batch in batches:
            data, bounds = text_buffer(batch.column(1))
            preds, scores = [], []
            for a, b in steps(bounds, 1 << 20):
                for c in range(a, b, _ROWS):
                    d = min(b, c + _ROWS)
                    rows, letters = presence(data[bounds[c] : bounds[d]], bounds[c : d + 1] - bounds[c])
                    margin = rows @ sent.value
                    share = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)).astype(np.float64))
                    share /= share.sum(axis=1, keepdims=True)
                    best = share.argmax(axis=1)
                    for k, top in enumerate(best.tolist()):
                        known = letters[k] > 0 and model is not None
                        preds.append(names[top] if known else UNDETERMINED)
                        scores.append(float(share[k, top]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, _held_out(id_col).alias("held_out")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of at least ``least``; ``und`` goes.

    So rows with a null or empty text or one without letters go, and all rows go where nothing could be learned (no row, or none with
    text, id and language). Null ids and languages stay if their text is identified; repeated rows go or stay together; other columns are
    carried along.
    """
    names, matrix = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col) or (None, None)
    if names is None:
        return docs.limit(0)
    sent = docs.sparkSession.sparkContext.broadcast(matrix)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, bounds = text_buffer(batch.column(place))
            keep = np.zeros(len(bounds) - 1, bool)
            for c in range(0, len(keep), _ROWS):
                d = min(len(keep), c + _ROWS)
                rows, letters = presence(data[bounds[c] : bounds[d]], bounds[c : d + 1] - bounds[c])
                margin = (rows @ sent.value).astype(np.float64)
                share = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
                keep[c:d] = (letters > 0) & (share.max(axis=1) / share.sum(axis=1) >= least)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
