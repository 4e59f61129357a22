"""A corpus-cleaning pipeline over ``documents``: language, near copies, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; each result is written
as Parquet in the shared folder and read again as the next stage's ``docs``.

All stages take empty tables (and return none or no rows), null ids, null and empty texts, texts of any length, repeated rows and further
columns; what they make of them is said below and, in full, at the operators.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitegauge.llm import decontam, langid, packing, passages, simhash
from sitegauge.llm.common import prepare, table
from sitegauge.runtime import shared_dir


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows; the others go, and so do null and empty texts and those without letters."""
    prepare(spark)
    return langid.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id, a null id last. An id that stands for several texts is several documents; rows alike in both stay together."""
    prepare(spark)
    return simhash.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat one of another document are cut out of all documents but one; null, empty and short texts have none. A text of which no word is left goes."""
    prepare(spark)
    return passages.drop_repeats(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; items without an id count, without a text they do not."""
    prepare(spark)
    return decontam.drop_leaky(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences of 1024. A null or empty text is its end token alone; repeated rows give their pieces each."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [("language_id", identified), ("simhash", distinct), ("substring_dedup", unrepeated), ("decontamination", untested), ("packing", packed)]

#: No stage but the first few of its steps can be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = table(prepare(spark), sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
