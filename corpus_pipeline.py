"""A training-corpus pipeline over `documents`: toxic documents go, of equal and of
near-equal texts one stays, sources are mixed to their weights, and the mix is
packed into windows of tokens. Each stage takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of docs, whatever their names. In every
stage a null text counts as empty, ids may be null or repeat, very long texts count
whole, and an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import exact_dedup, minhash, mix_wfq, packing, toxicity
from loomgraph.llm.common import Scratch, documents


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from all labelled documents; scores of a half or more go. Empty texts have
    the score of no words; rows that repeat go or stay together."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays, null last; of repeated rows one; a null
    text equals an empty one, and of these one stays too."""
    return exact_dedup.keep_largest(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, a similarity of 0.8 or more; the smallest id of a group stays,
    null last. Rows go by id and text, so a text that only shares an id stays; texts
    without words are copies of nothing."""
    return minhash.keep_first(docs, width=5, threshold=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix holds them, none to twice; texts without words never.
    Ties of the shuffle go by id and size; null sources are one source, the last."""
    return mix_wfq.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1,024 ids; every row, also one that repeats, is packed by itself, and an
    empty text is one id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mix", mixed_sources),
    ("pack", packed),
]

#: Learned scores, near-duplicate groups and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return docs
