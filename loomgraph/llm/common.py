"""Helpers that the training-data operators share; above all, a join that survives
hot keys."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.scratch import Scratch, drop, shared_root

#: A word: a run of anything but the space and the five ASCII controls \t..\r.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "Scratch", "documents", "drop", "giving_back", "lookup", "shared_root"]

Batches = Iterator[pa.RecordBatch]


def giving_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, for mapInArrow, that gives freed memory back to the system as its task
    ends: workers live on through later stages, which need that memory themselves."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not in every C library
                trim(0)

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, by: list[str]) -> DataFrame:
    """rows LEFT JOIN groups on key, where `size` says how many rows each key has.

    A key that more than one row in a thousand carries is hot. There can be at
    most 1,000 such keys whatever the input, so their side is broadcast; all
    other keys meet in a shuffled join. Rows of hot or null keys go to the shuffle
    under a key spread over `by`, so no task gets more than its share.

    Empty inputs give an empty result; a null key finds nothing.
    """
    values = [c for c in groups.columns if c != key]
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(total // 1000, 1000)
    hot = groups.where(F.col(size) > limit).select(F.col(key).alias("__k"), F.struct(*values).alias("__hot"))
    kept = lambda c: F.concat(F.lit("="), F.hex(c))
    cold = groups.where(F.col(size) <= limit).select(kept(F.col(key)).alias("__c"), F.struct(*values).alias("__cold"))
    loose = F.concat(F.lit("~"), F.hex(F.xxhash64(*by)))
    first = rows.join(F.broadcast(hot), F.col(key) == F.col("__k"), "left")
    first = first.withColumn("__j", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), kept(F.col(key))).otherwise(loose))
    both = first.join(cold, F.col("__j") == F.col("__c"), "left")
    out = [F.coalesce(F.col("__hot")[v], F.col("__cold")[v]).alias(v) for v in values]
    return both.select(*rows.columns, *out, "__j")

