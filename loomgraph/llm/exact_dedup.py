"""Exact deduplication by skew-safe combining.

Three stages, each grouping by digest *and* full text, so that equal digests of
unequal texts never merge:

1. local: the map side of the first aggregation leaves one row per text and task;
2. salted: those rows meet by (digest, text, salt); the salt comes from the task,
   so a text that every task holds is spread over `salts` reducers;
3. global: the at most `salts` winners of each text are combined.

Texts are equal when identical; null counts as empty. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, lookup

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _combined(docs: DataFrame, payload: list[str], salts: int, digest) -> DataFrame:
    """One row per distinct text: digest, text, keep_id, group_size and, if asked
    for, `row`: the payload columns of the row that stays."""
    rows = docs.select(
        F.col("doc_id").alias("keep_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        *([F.struct(F.col("doc_id").alias("__id"), *[F.col(f"`{c}`") for c in payload]).alias("row")] if payload else []),
    )
    rows = rows.withColumn("digest", digest(F.col("text"))).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    # null ids rank below all others; max_by leaves the payload null only if all are null
    best = lambda: [F.max_by("row", F.coalesce("keep_id", F.lit(-(2**63)))).alias("row")] if payload else []
    salted = rows.groupBy("digest", "text", "salt").agg(F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), *best())
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), *best())


def keep_largest(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """docs with one row of each distinct text, that with the largest doc_id.

    Of repeated rows (same doc_id and text) one stays; a null text equals an empty
    one and the row that stays keeps its own; null ids lose to all others. An empty table gives an
    empty table; all columns of the input come back.
    """
    others = [c for c in docs.columns if c not in ("text",)]
    best = _combined(docs.withColumn("__was_null", F.col("text").isNull()), [*others, "__was_null"], salts, digest)
    text = F.when(F.col("row.__was_null"), F.lit(None).cast("string")).otherwise(F.col("text"))
    return best.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def exact_groups(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the largest doc_id among equal texts (null if all are null), kept
    marks the row that stays; of repeated rows with that id just one. Extra columns
    of the input are ignored. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    groups = scratch.table(_combined(docs, [], salts, digest).drop("text"), "groups")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = digest(F.col("text"))
    if not groups.groupBy("digest").count().where("count > 1").isEmpty():
        # unequal texts share a digest: the text itself becomes the key
        key = F.concat(F.lit("="), F.col("text")).cast("binary")
        groups = _combined(docs, [], salts, digest).withColumn("digest", key)
    found = groups.where("group_size > 1").select(F.col("digest").alias("key"), F.struct("keep_id").alias("keep"), "group_size")
    joined = lookup(rows.select("doc_id", key.alias("key"), sha256(F.col("text")).alias("sha")), found, "key", "group_size", ["doc_id"])
    # joined is dealt by __j; the window needs no further exchange
    same = F.row_number().over(Window.partitionBy("__j", "key", "doc_id").orderBy(F.lit(1)))
    joined = joined.withColumn("__n", same)
    keep = F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("__n") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
